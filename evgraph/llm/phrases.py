"""Phrases whose words keep together, by level-wise counts of word sequences."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evgraph.llm.common import mix64, quoted, stage

#: Characters that end a piece; no phrase goes over one.
ENDS = ".,;:!?\n\v\f\r"
#: Bits of the filter of frequent sequences that tasks get: eight megabytes, always.
FILTER_BITS = 1 << 26
#: Bytes of text whose sequences are counted together before they are handed on.
CHUNK = 2 << 20
#: The language of texts without one.
UNKNOWN = "und"

_ENDS = [x.encode() for x in ENDS]
_TABLE = bytes.maketrans(ENDS.encode() + b"\t", b"\n" * len(ENDS) + b" ")


@dataclass
class Words:
    """The words of texts in order as places in ``distinct``, -1 between pieces."""

    at: np.ndarray
    distinct: pa.Array


def _words(texts: list[bytes]) -> Words:
    line = b"\n".join(texts).lower().translate(_TABLE)  # bytes.lower changes A-Z alone
    line = line.replace(b"\n", b" \n ")
    coded = pc.split_pattern(pa.array([line], pa.large_binary()), pattern=" ").values.dictionary_encode()
    at, distinct = coded.indices.to_numpy().astype(np.int64), coded.dictionary.cast(pa.binary())
    # Blanks that follow each other have an empty word between them.
    empty, end = (pc.index(distinct, pa.scalar(x, distinct.type)).as_py() for x in (b"", b"\n"))
    at = at[at != empty]
    return Words(np.where(at == end, -1, at), distinct)


def _chunks(found: list[tuple[bytes, bytes]], size: int = CHUNK) -> Iterator[tuple[bytes, Words]]:
    """(language, words) of texts, some ``size`` bytes at a time; texts over that are cut
    between pieces."""
    by_lang: dict[bytes, list[bytes]] = {}
    held: dict[bytes, int] = {}
    for lang, text in found:
        while len(text) > size:
            cut = 1 + max(text.rfind(x, 0, size) for x in _ENDS) or 1 + min((i for i in map(text.find, _ENDS) if i >= 0), default=-1)
            if not cut:
                break
            yield lang, _words([text[:cut]])
            text = text[cut:]
        by_lang.setdefault(lang, []).append(text)
        held[lang] = held.get(lang, 0) + len(text)
        if held[lang] > size:
            yield lang, _words(by_lang.pop(lang))
            held.pop(lang)
    for lang, texts in by_lang.items():
        yield lang, _words(texts)


#: What hashes of words are polynomials of, and its inverse modulo 2**64.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base, dtype=np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(out, dtype=np.uint64)


def _hashes(words: pa.Array, lang: bytes) -> np.ndarray:
    """A hash of each word: of its bytes as a polynomial, from prefix sums over all bytes
    that stand between the words' ends."""
    words = pa.concat_arrays([words])  # at offset 0
    _, ends, data = words.buffers()
    ends = np.frombuffer(ends, dtype=np.int32, count=len(words) + 1).astype(np.int64)
    held = np.frombuffer(data, dtype=np.uint8)[ends[0] : ends[-1]] if ends[-1] > ends[0] else np.zeros(0, np.uint8)
    ends = ends - ends[0]
    with np.errstate(over="ignore"):
        sums = np.zeros(len(held) + 1, dtype=np.uint64)
        np.cumsum((held.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(held))[:-1], out=sums[1:])
        own = (sums[ends[1:]] - sums[ends[:-1]]) * _powers(_INVERSE, len(held))[ends[:-1]]
        return mix64(own ^ np.uint64(xxhash.xxh64_intdigest(lang)))


def _combined(parts: list[np.ndarray]) -> np.ndarray:
    """One hash of sequences of words, given those of their words."""
    out = mix64(parts[0])
    for part in parts[1:]:
        out = mix64(out * np.uint64(3) + part)
    return out


def _places(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of a filter that a hash sets."""
    return h & np.uint64(bits - 1), (h >> np.uint64(32)) & np.uint64(bits - 1)


def _held(marks: np.ndarray, h: np.ndarray) -> np.ndarray:
    a, b = _places(h, 64 * len(marks))
    at = lambda x: (marks[(x >> np.uint64(6)).astype(np.int64)] >> (x & np.uint64(63))) & np.uint64(1)
    return (at(a) & at(b)).astype(bool)


def sequences(words: Words, lang: bytes, k: int, marks: np.ndarray | None) -> tuple[pa.Array, np.ndarray]:
    """The sequences of ``k`` words within pieces and how often each is there, but none of
    which ``marks`` says that its first or its last k - 1 words are not frequent."""
    at, distinct = words.at, words.distinct
    if k == 1:
        n = np.bincount(at[at >= 0], minlength=len(distinct))
        return distinct.take(pa.array(np.flatnonzero(n))), n[n > 0]
    # How many words follow within the piece, the word itself counted.
    end = np.append(np.flatnonzero(at < 0), len(at))
    left = np.repeat(end, np.diff(end, prepend=-1))[: len(at)] - np.arange(len(at))
    first = np.flatnonzero(left >= k)
    if marks is not None and len(first):
        h = _hashes(distinct, lang)[at]  # between pieces any, as no sequence goes there
        i = np.flatnonzero(left >= k - 1)
        fine = np.zeros(len(at) + 1, dtype=bool)
        fine[i] = _held(marks, _combined([h[i + j] for j in range(k - 1)]))
        first = first[fine[first] & fine[first + 1]]
    code = at[first]
    for j in range(1, k):
        code = (np.unique(code, return_inverse=True)[1] if j > 1 else code) * len(distinct) + at[first + j]
    _, where, n = np.unique(code, return_index=True, return_counts=True)
    parts = [distinct.take(pa.array(at[first[where] + j])) for j in range(k)]
    return pc.binary_join_element_wise(*parts, b" "), n


def _strings(values: pa.Array) -> pa.Array:
    return values.cast(pa.binary()).view(pa.string())


def _level(docs: DataFrame, k: int, marks, least: int) -> DataFrame:
    """(lang, phrase, a) of all sequences of ``k`` words that are there ``least`` times. Level
    1 also has the number of all words of a language, beside an empty phrase."""

    def emit(batches):
        known = None if marks is None else marks.value
        rows = (part for batch in batches for start in range(0, batch.num_rows, 256) for part in [batch.slice(start, 256)])
        for part in rows:
            langs, texts = (part.column(i).cast(pa.binary()).to_pylist() for i in (0, 1))
            for lang, words in _chunks(list(zip(langs, texts, strict=True))):
                found, n = sequences(words, lang, k, known)
                if k == 1:
                    found, n = pa.concat_arrays([found, pa.array([b""], found.type)]), np.append(n, n.sum())
                lang_of = pa.array([lang], pa.binary()).take(pa.array(np.zeros(len(n), dtype=np.int64)))
                yield pa.record_batch([_strings(lang_of), _strings(found), pa.array(n, pa.int64())], names=["lang", "phrase", "a"])

    seen = docs.mapInArrow(emit, "lang string, phrase string, a long").groupBy("lang", "phrase").agg(F.sum("a").alias("a"))
    return stage(seen.filter((F.col("a") >= least) | (F.col("phrase") == "")), f"level{k}")


def _filter(level: DataFrame, bits: int) -> np.ndarray:
    """A Bloom filter of the phrases of a level. Its parts are made where the phrases are
    and put together by words of 64 bits, so the driver gets ``bits`` bits at most,
    however many phrases there are; a fuller filter lets more through, never less."""

    def mark(batches):
        for batch in batches:
            langs, found = (batch.column(i).cast(pa.binary()) for i in (0, 1))
            h = np.zeros(len(found), dtype=np.uint64)
            for lang in langs.unique():
                rows = np.flatnonzero(pc.equal(langs, lang))
                parts = pc.split_pattern(found.take(pa.array(rows)), pattern=" ").values
                words = _hashes(parts, lang.as_py()).reshape(len(rows), -1)
                h[rows] = _combined(list(words.T))
            at = np.unique(np.concatenate(_places(h, bits)))
            word, bit = (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63))
            start = np.flatnonzero(np.append(True, word[1:] != word[:-1])) if len(word) else np.zeros(0, int)
            ored = np.bitwise_or.reduceat(bit, start) if len(word) else bit
            yield pa.record_batch([pa.array(word[start], pa.int64()), pa.array(ored.view(np.int64), pa.int64())], names=["w", "b"])

    parts = level.filter("phrase <> ''").select("lang", "phrase").mapInArrow(mark, "w long, b long")
    got = parts.groupBy("w").agg(F.expr("bit_or(b)").alias("b")).toArrow()
    marks = np.zeros(bits // 64, dtype=np.uint64)
    marks[got["w"].to_numpy()] = got["b"].to_numpy().view(np.uint64)
    return marks


def score(a: Column, left: Column, right: Column) -> Column:
    """floor(2000000 a / (left + right)), exact for all longs."""
    whole = lambda c: c.cast("decimal(20,0)")
    return F.call_function("div", whole(a) * F.lit(2_000_000).cast("decimal(7,0)"), whole(left) + whole(right))


def collocations(
    docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = 4, least: int = 30, most: int = 2000,
    share: int = 80, filter_bits: int = FILTER_BITS,
) -> DataFrame:
    """Of each language the first ``most`` phrases: lang, rank, phrase, a, l, r, n, score.

    Texts are lower-cased (A-Z), cut into pieces at ``ENDS`` and into words at blanks and
    tabs. A phrase is 2 to ``longest`` words of a piece that occur ``least`` times or more (a).
    Cut after its k first words, it scores floor(2000000 a / (l + r)), by how often both
    parts occur; the least score counts, at the least k. A phrase within a longer one that
    occurs ``share`` percent as often or more goes. ``n`` counts all words.

    Sequences are counted level by level. The tasks of level k get a Bloom filter of the
    frequent sequences of level k - 1, of ``filter_bits`` bits at any size of the corpus,
    and emit a sequence only if it holds both its first and its last k - 1 words. It can
    only let too much through, and what is counted decides, so counts are exact.
    Sequences are summed in chunks of text, then by tasks, then by key, so a frequent one
    is a few rows a task. Counts of parts are joined to the cuts by equal keys, which
    Spark splits where many phrases begin or end alike. The first of a language are found
    among the first of as many parts as there are shuffle partitions (256 at most).

    Null texts are empty, a null language is ``und``. Texts of any length are read whole,
    cut between pieces where they are long; memory is bounded by the longest piece.
    Repeated rows count each time; ties of score and count go by phrase, in byte order. An
    empty table gives an empty result. Other columns are not read, whatever their names.
    """
    if longest < 2 or filter_bits < 64 or filter_bits & (filter_bits - 1) or filter_bits > 1 << 32:
        raise ValueError("phrases have two words or more, filters a power of two of bits from 64 to 2**32")
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(quoted(lang).cast("string"), F.lit(UNKNOWN)).alias("lang"), quoted(text).alias("text")).filter("text <> ''")
    levels, marks = [_level(rows, 1, None, least)], None
    for k in range(2, longest + 1):
        marks = spark.sparkContext.broadcast(_filter(levels[-1], filter_bits))
        levels.append(_level(rows, k, marks, least))
    sizes = levels[0].filter("phrase = ''").select(F.col("lang").alias("of"), F.col("a").alias("n"))
    every = levels[0].filter("phrase <> ''").withColumn("k", F.lit(1))
    for k, level in enumerate(levels[1:], 2):
        every = every.union(level.withColumn("k", F.lit(k)))
    words = F.split("phrase", " ", -1)
    part = lambda start, n: F.array_join(F.slice("w", start, n), " ")
    long = every.filter("k > 1").withColumn("w", words)
    cuts = F.transform(F.sequence(F.lit(1), F.col("k") - 1), lambda j: F.struct(j.alias("j"), part(F.lit(1), j).alias("head"), part(j + 1, F.col("k") - j).alias("rest")))
    cuts = long.select("lang", "phrase", "a", F.inline(cuts))
    of = lambda name, at: every.select(F.col("lang").alias(f"{name}_lang"), F.col("phrase").alias(f"{name}_part"), F.col("a").alias(name))
    for name, at in (("l", "head"), ("r", "rest")):
        cuts = cuts.join(of(name, at), (F.col("lang") == F.col(f"{name}_lang")) & (F.col(at) == F.col(f"{name}_part"))).drop(f"{name}_lang", f"{name}_part", at)
    scored = cuts.withColumn("score", score(F.col("a"), F.col("l"), F.col("r")))
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("k") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("k") - n + 1), lambda i: part(i, n))))
    within = long.filter("k > 2").select("lang", F.explode(inner).alias("phrase"), F.col("a").alias("longer"))
    both = scored.unionByName(within, allowMissingColumns=True).groupBy("lang", "phrase")
    best = F.min(F.when(F.col("score").isNotNull(), F.struct("score", "j", "l", "r"))).alias("b")
    kept = both.agg(best, F.max("a").alias("a"), F.max("longer").alias("longer")).filter(f"longer is null or 100 * longer < {share} * a")
    kept = kept.select("lang", "phrase", "a", "b.l", "b.r", "b.score")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    salts = min(256, int(spark.conf.get("spark.sql.shuffle.partitions")))
    parts = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(salts))).orderBy(*order)
    first = kept.withColumn("rank", F.row_number().over(parts)).filter(F.col("rank") <= most)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")
    top = first.withColumn("rank", rank).filter(F.col("rank") <= most)
    return top.join(sizes, F.col("lang") == F.col("of")).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
