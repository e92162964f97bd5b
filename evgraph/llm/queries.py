"""The registered queries of the training-data operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evgraph.llm import chat, embeddings, html, merkle, mixing, oracles, packing, phrases, quality, rules, sharding, simhash, tokens, toxicity
from evgraph.llm.common import read


def _crc32(text: Column) -> Column:
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = sharding.shard(read(spark, sf_dir, "documents").select("doc_id", "text"), n_shards=40)
    return docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        _crc32(F.col("text")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.score(docs).select("doc_id", *quality.ADDED)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    # Of every copy that is taken, where the splitting tree puts it, and its place there.
    of_copies = lambda field: F.concat_ws(",", F.transform("copies", lambda c: c[field].cast("string"))).alias(f"{field}s")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken", of_copies("shard"), of_copies("order"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, read(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select("doc_id", "severity", "grade", "toxic")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    packed = packing.pack(docs, size=2048, end=0, path=tokens.default_path(), with_ids=False)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return tokens.section_tokens(docs, tokens.head_and_body, path=tokens.default_path(), rule="most")


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = html.extract(read(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return simhash.near_duplicates(docs).select("doc_id", "fingerprint", "component_id")


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    schema = "conv_id long, turn long, role string, text string"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], schema)
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.read_back(chat.format_conversations(turns))


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    found = embeddings.near_duplicates(vectors, cosine=0.95)
    return found.select("vec_id", "n_links", "component_id", "kept")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    of = lambda text: merkle.leaf(*[F.col(c) for c in ("doc_id", "source", "lang", "n_chars")], text)
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    leaves = docs.select("doc_id", "source", of(F.col("text")).alias("leaf"), F.when(tampered, of(F.replace("text", F.lit("\n"), F.lit("")))).alias("now"))
    known = merkle.manifest(leaves, group="source", order="doc_id")
    folded = merkle.fold(F.coalesce("now", "leaf"), F.col("proof")).alias("folded_root")
    found = known.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("proof")).alias("proof_sha256"), folded)
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = rules.train(docs, read(spark, sf_dir, "labels"))
    return rules.score(docs, model).select("doc_id", rules.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op13_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(read(spark, sf_dir, "documents").select("text", "lang"))


QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_mixing": op2_mixing,
    "op3_quality_rules": op3_quality_rules,
    "op4_toxicity": op4_toxicity,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_token_counts": op6_token_counts,
    "op7_html_extraction": op7_html_extraction,
    "op8_simhash": op8_simhash,
    "op9_chat_formatting": op9_chat_formatting,
    "op10_embedding_near_dedup": op10_embedding_near_dedup,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_quality_classifier": op12_quality_classifier,
    "op13_phrase_mining": op13_phrase_mining,
}
SQL = {"op3_quality_rules": oracles.QUALITY, "op9_chat_formatting": oracles.CHAT, "op11_merkle_manifest": oracles.MERKLE, "op13_phrase_mining": oracles.PHRASES}
