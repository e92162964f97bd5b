"""Phrase mining against counts made in one place, and odd rows."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from evgraph.llm import phrases
from pyspark.sql import functions as F

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def plain(rows, longest=4, least=30, most=2000, share=80):
    """The same, by counting every sequence of words."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                f.update((lang, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    found, longer = defaultdict(list), Counter()
    frequent = {x: a for x, a in f.items() if a >= least and len(x[1]) > 1}
    for (lang, w), a in frequent.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                longer[lang, w[i : i + k]] = max(longer[lang, w[i : i + k]], a)
    for (lang, w), a in frequent.items():
        if 100 * longer[lang, w] >= share * a and longer[lang, w]:
            continue
        cuts = [(2_000_000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w))]
        score, _, left, right = min(cuts)
        found[lang].append((-score, -a, " ".join(w).encode(), left, right))
    out = []
    for lang, best in found.items():
        for rank, (score, a, phrase, left, right) in enumerate(sorted(best)[:most], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def mined(df, **how):
    got = phrases.collocations(df, **how)
    assert got.columns == COLUMNS
    return sorted(tuple(r) for r in got.collect())


def texts(seed, n=60):
    rng = random.Random(seed)
    words = ["a", "B", "cé", "É", "the", "New", "york", "x1", " ", "d-e", "İ"]
    ends = [" ", " ", "  ", "\t", " ", " ", ". ", ",", "\n", "\r", "\v", "\f", " ; ", "!?"]
    out = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randrange(0, 80)):
            parts.append("new York city\tHALL" if rng.random() < 0.1 else rng.choice(words))
            parts.append(rng.choice(ends))
        out.append((rng.choice(["en", "en", "fr", None, ""]), "".join(parts)))
    return out


@pytest.mark.parametrize(("least", "most", "share", "bits"), [(3, 2000, 80, 1 << 20), (5, 7, 50, 64), (2, 2000, 100, 1 << 12)])
def test_against_all_sequences(spark, least, most, share, bits):
    rows = [*texts(least), (None, None), ("en", ""), ("de", " . "), ("und", "new york new york new york")]
    df = spark.createDataFrame(rows, "lang string, text string")
    got = mined(df, least=least, most=most, share=share, filter_bits=bits)
    assert got and got == plain(rows, least=least, most=most, share=share)


def test_hot_words_and_lines(spark):
    """One line in most texts, one word in all, and languages of very different size."""
    rows = [("en", f"all rights reserved by w{i} the the the the") for i in range(400)] + texts(9, 30)
    df = spark.createDataFrame(rows, "lang string, text string").repartition(8)
    assert mined(df) == plain(rows)


def test_chunks_end_between_pieces(monkeypatch):
    texts_of = [(b"en", b"a b c. " * 50), (b"fr", b"x y"), (b"en", b"one piece without an end " * 20), (b"en", b"")]
    cut = list(phrases._chunks(texts_of, size=60))
    whole = list(phrases._chunks(texts_of, size=1 << 20))
    assert len(cut) > 5 and len(whole) == 2
    for k in (1, 2, 3, 4):
        sums = []
        for chunks in (cut, whole):
            seen = Counter()
            for lang, words in chunks:
                found, times = phrases.sequences(words, lang, k, None)
                for p, n in zip(found.to_pylist(), times, strict=True):
                    seen[lang, p] += int(n)
            sums.append(seen)
        assert sums[0] == sums[1]


def test_a_filter_loses_nothing():
    words = pa.array([f"w{i}".encode() for i in range(500)])
    h = phrases._combined([phrases._hashes(words, b"en")])
    alone = np.concatenate([phrases._hashes(words.slice(i, 1), b"en") for i in range(500)])
    assert (phrases._combined([alone]) == h).all() and len(set(h.tolist())) == 500
    assert (phrases._hashes(words, b"fr") != phrases._hashes(words, b"en")).all()
    assert len(set(phrases._hashes(pa.array([b"", b"\0", b"\0\0", b"a", b"aa"]), b"").tolist())) == 5
    marks = np.zeros(1 << 10, dtype=np.uint64)
    for place in np.concatenate(phrases._places(h[:250], 1 << 16)).tolist():
        marks[place >> 6] |= np.uint64(1) << np.uint64(place & 63)
    held = phrases._held(marks, h)
    assert held[:250].all() and held[250:].mean() < 0.1


def test_scores_are_exact_beyond_64_bits(spark):
    values = [(9_223_372_036_854_775_807 // 2, 4_611_686_018_427_387_903, 4_611_686_018_427_387_904), (7, 10, 11), (10**13, 10**13, 3 * 10**13 + 1), (1, 10**18, 10**18)]
    df = spark.createDataFrame(values, "a long, l long, r long")
    got = [r[0] for r in df.select(phrases.score(F.col("a"), F.col("l"), F.col("r")).cast("long")).collect()]
    assert got == [2_000_000 * a // (l + r) for a, l, r in values]


def test_odd_tables(spark):
    schema = "lang string, text string, phrase int, `RANK` string"
    assert mined(spark.createDataFrame([], schema)) == []
    assert mined(spark.createDataFrame([(None, None, 1, "")] * 3, schema)) == []
    long = ("en", "one two three four five " * 40_000, 1, "x")
    assert mined(spark.createDataFrame([long], schema), most=4) == plain([long[:2]], most=4)
    with pytest.raises(ValueError):
        phrases.collocations(spark.createDataFrame([], schema), filter_bits=100)
