"""The rule ensemble: planted quality, held-out accuracy, rules as expressions, odd rows."""

import math
import os
import random
import re
import zlib

import numpy as np
import pytest
from evgraph.llm import queries, rules
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.01"
SMALL = {"trees": 12}


def prose(rng, n):
    words = ["the", "and", "of", "to", "in", "river", "stone", "walked", "morning", "over", "quiet", "house", "a", "because"]
    out = [rng.choice(words) + ("." if rng.random() < 0.1 else "") for _ in range(n)]
    return " ".join(out)


def corpus(seed, n):
    rng, docs, labels = random.Random(seed), [], []
    for i in range(n):
        text, good = prose(rng, rng.randrange(30, 300)), i % 4 != 0
        if not good:
            kind = i // 4 % 3
            if kind == 0:
                text = " ".join(w + "###" for w in text.split())
            elif kind == 1:
                text = text.upper() + "!! "
            else:
                text = "buy now " * 60
        docs.append((i, text))
        labels.append((i, int(good)))
    return docs, labels


def test_planted_quality_on_held_out_texts(spark):
    docs, labels = corpus(1, 800)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int")
    model = rules.train(df, lab, **SMALL)
    assert 0 < len(model.rules) < 60
    got = rules.score(df, model).withColumn("out", rules.held_out(F.col("doc_id"))).collect()
    truth = dict(labels)
    assert {r.doc_id for r in got if r.out} == {i for i, _ in docs if zlib.crc32(str(i).encode()) % 4 == 2}
    held = [r.predicted == truth[r.doc_id] for r in got if r.out]
    assert len(held) > 100 and np.mean(held) >= 0.98
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    # A second fit is the same, and labels of held-out texts change nothing.
    turned = [(i, 1 - y if zlib.crc32(str(i).encode()) % 4 == 2 else y) for i, y in labels]
    again = rules.train(df.repartition(3), spark.createDataFrame(turned, "doc_id long, quality int"), **SMALL)
    assert again == model


def test_rules_are_the_same_in_both_forms(spark):
    docs, labels = corpus(2, 300)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    model = rules.train(df, spark.createDataFrame(labels, "doc_id long, quality int"), **SMALL)
    s = rules.statistics(F.col("text"))
    rows = df.select(s.alias("s")).withColumn("p", model.probability(F.col("s"))).collect()
    x = np.array([[r.s[k] for k in rules.STATISTICS] for r in rows])
    assert np.allclose(model.predict(x), [r.p for r in rows], atol=1e-12)


def test_statistics_of_a_text(spark):
    text = "The river, the Stone.\n\nThe river, the Stone.\n### a|b 12!"
    row = spark.createDataFrame([(text,)], "text string").select(rules.statistics(F.col("text")).alias("s")).first().s
    words = text.split()
    want = {
        "word_chars": sum(map(len, words)) / len(words), "symbols": 4 / len(words), "marks": 1 / len(words),
        "stop_words": 4 / len(words), "line_words": math.log1p(len(words) / 3), "dup_lines": 1 / 3, "repeat_words": 8 / len(words),
        "variety": math.log1p(len(set(words))) / math.log1p(len(words)), "capitals": 4 / len(text), "digits": 2 / len(text), "stops": 2 / len(words),
        "commas": 2 / len(words), "bars": len(re.findall(r"\|", text)) / len(words),
    }
    assert {k: round(row[k], 9) for k in rules.STATISTICS} == {k: round(v, 9) for k, v in want.items()}


def test_paths_of_a_tree_are_conjunctions():
    rng = np.random.default_rng(4)
    x = rng.random((600, len(rules.STATISTICS)))
    y = ((x[:, 2] > 0.5) & (x[:, 5] <= 0.3)).astype(float)
    found = rules.rules_of(x, y, trees=20, depth=3, least=5)
    assert all(len({c[0] for c in r.conditions}) == len(r.conditions) <= 3 for r in found)
    model = rules.fit(x, y, np.arange(600) % 4 == 0, trees=20)
    fresh = rng.random((500, len(rules.STATISTICS)))
    told = model.predict(fresh) >= 0.5
    assert np.mean(told == ((fresh[:, 2] > 0.5) & (fresh[:, 5] <= 0.3))) > 0.95
    # Few rules are left of those that the trees have.
    assert len(model.rules) < len(found)


def test_odd_rows(spark):
    schema = "doc_id long, text string, SCORE string, `a.b` int"
    docs, labels = corpus(3, 200)
    lab = spark.createDataFrame([*labels, (None, 1), (5, None), (1, 0), (10**9, 0)], "doc_id long, quality int")
    rows = [(i, t, "s", 1) for i, t in docs]
    odd = [(None, None, None, None), (None, "", "s", 1), (-1, None, "s", 1), (-2, " \n\t ", "s", 1), (-3, "the quiet house " * 30_000, "s", 1), (7, docs[7][1], "s", 1)]
    df = spark.createDataFrame(rows + odd, schema)
    model = rules.train(df, lab, **SMALL)
    got = rules.score(df, model)
    assert got.columns == ["doc_id", "text", "a.b", "score", "predicted"]
    found = got.collect()
    assert len(found) == len(rows) + len(odd) and all(0 <= r.score <= 1 for r in found)
    assert len({r.score for r in found if not (r.text or "").strip()}) == 1
    assert len({r.score for r in found if r.doc_id == 7}) == 1
    assert rules.score(df.limit(0), model).count() == 0
    assert [r[0] for r in df.filter("doc_id is null").select(rules.held_out(F.col("doc_id"))).collect()] == [False, False]
    with pytest.warns(UserWarning, match="no labels"):
        none = rules.train(df.limit(0), lab, **SMALL)
    assert none.rules == () and rules.score(df, none).select("score").distinct().collect()[0].score == 0.5


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_held_out_labels(spark):
    got = queries.op12_quality_classifier(spark, DATA)
    lab = spark.read.parquet(f"{DATA}/labels.parquet")
    told = [(r.predicted, r.quality) for r in got.filter("held_out").join(lab, "doc_id").collect()]
    assert len(told) > 50 and np.mean([p == q for p, q in told]) >= 0.95
