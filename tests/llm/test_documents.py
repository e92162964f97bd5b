"""Operators on documents: results against brute force, and odd inputs."""

import collections
import random
import re
import tracemalloc
import zlib

import numpy as np
import pytest
from evgraph.llm import mixing, packing, quality, sharding, simhash, tokens, toxicity
from evgraph.llm.common import permute
from hypothesis import given, settings
from hypothesis import strategies as st

SCHEMA = "doc_id long, text string, source string"
LONG = "word " * 60_000
ODD = [
    (1, None, "a"),
    (2, "", "a"),
    (3, "   \n\t ", None),
    (None, "no id here at all", "b"),
    (5, "twice the same", "b"),
    (5, "twice the same", "b"),
    (6, LONG, "c"),
    (7, "dör Müller\x0bging fort ẞ 😀 🏳️‍🌈", None),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def prose(spark):
    rng = random.Random(3)
    words = [f"w{rng.randrange(900)}x" for _ in range(4000)]
    rows = []
    for i in range(300):
        n = rng.choice([3, 20, 80, 200, 900])
        rows.append((i, " ".join(rng.choice(words) for _ in range(n)), rng.choice(["s1", "s1", "s1", "s2", "s3", None])))
    rows += [(1000 + i, rows[7][1], "s1") for i in range(40)]
    return spark.createDataFrame(rows, SCHEMA)


# sharding


@pytest.mark.parametrize("n", [1, 2, 3, 17, 1000, 65537])
def test_permute_is_a_bijection(n):
    assert sorted(permute(np.arange(n), np.full(n, n), np.full(n, 5, dtype=np.uint64))) == list(range(n))


def test_split_tree_rows_add_up():
    tree = sharding.SplitTree(np.array([5, 0, 7, 3]), np.array([4, 4, 7]), 9)
    rows = [tree.row(i) for i in range(4)]
    assert [int(r[0].sum()) for r in rows] == [5, 0, 7, 3]
    assert sum(r[0] for r in rows).tolist() == [4, 4, 7]
    assert (rows[3][1] == sum(r[0] for r in rows[:3])).all()


def test_shards_are_uniform(spark):
    """Where rows of each block end up, over all places: chi-square over several seeds."""
    rows = spark.range(0, 16_000, 1, 8).selectExpr("id as doc_id", "int(id div 2000) as block")
    total = 0.0
    for seed in range(5):
        out = sharding.shard(rows, n_shards=40, seed=seed).toPandas()
        place = (out["shard"] * 400 + out["slot"]).to_numpy()
        assert sorted(place) == list(range(16_000))
        seen = np.zeros((8, 40))
        np.add.at(seen, (out["block"].to_numpy(), place // 400), 1)
        total += ((seen - 50) ** 2 / 50).sum()
        follow = np.diff(out.sort_values("doc_id")["shard"].to_numpy()) == 0
        assert abs(follow.mean() - 1 / 40) < 0.006
    freedom = 5 * 7 * 39
    assert abs(total - freedom) < 5 * np.sqrt(2 * freedom)


def test_large_hypergeometric_has_the_right_moments(monkeypatch):
    monkeypatch.setattr(sharding, "_NUMPY_MOST", 10)
    rng = np.random.default_rng(1)
    found = [sharding._hypergeometric(rng, 30, 50, 20) for _ in range(4000)]
    assert abs(np.mean(found) - 7.5) < 0.15 and abs(np.std(found) - np.sqrt(20 * 0.375 * 0.625 * 60 / 79)) < 0.15
    assert sharding._hypergeometric(rng, 0, 5, 3) == 0 and sharding._hypergeometric(rng, 5, 0, 3) == 3


def test_shards_are_exact_and_gapless(prose):
    out = sharding.shard(prose.repartition(5), n_shards=7).select("doc_id", "text", "shard", "slot").toPandas()
    sizes = out.groupby("shard").slot.agg(["size", "max"])
    assert len(out) == 340 and sizes["size"].max() - sizes["size"].min() <= 1
    assert all(sorted(s) == list(range(len(s))) for _, s in out.groupby("shard").slot)
    assert collections.Counter(out.text) == collections.Counter(r.text for r in prose.collect())


def test_sharding_odd_rows(odd, empty, spark):
    out = sharding.shard(odd, n_shards=40).collect()
    assert len(out) == len(ODD) and len({(r.shard, r.slot) for r in out}) == len(ODD)
    assert sharding.shard(empty, 40).count() == 0
    clash = spark.createDataFrame([(1, "x", 9, "y")], "doc_id long, Shard string, SLOT int, block string")
    got = sharding.shard(clash, 1).first()
    assert (got.shard, got.slot, got.block) == (0, 0, "y")


# mixing


def test_targets_share_the_excess():
    got = mixing.targets(np.array([100, 100, 1000, 0]), np.array([1.0, 2, 3, 1]), 3)
    assert got[1] == 300 and got[3] == 0 and abs(got.sum() - 1200) < 1e-6
    assert (got <= 3 * np.array([100, 100, 1000, 0]) + 1e-9).all()


def test_mix_comes_near_its_targets(prose):
    out = mixing.mix(prose).select("doc_id", "source", "text", "size", "source_size", "target", "taken", "copies").toPandas()
    assert (out["size"] == out.text.map(lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t)))).all()
    assert (out.taken <= 3 * out["size"]).all()
    for _, g in out.groupby(out.source.fillna("~")):
        assert g["size"].sum() == g.source_size.iloc[0]
        assert abs(g.taken.sum() - g.target.iloc[0]) <= 450  # half of the longest text
    order = [s or "~" for s in ["s1", "s2", "s3", None]]
    shares = [out[out.source.fillna("~") == s].target.iloc[0] for s in order]
    assert abs(sum(shares) - out["size"].sum()) < 1e-6
    again = mixing.mix(prose.repartition(3)).select("doc_id", "taken").toPandas()
    assert dict(zip(out.doc_id, out.taken, strict=True)) == dict(zip(again.doc_id, again.taken, strict=True))


def test_mix_goes_on_past_a_long_text(spark):
    rng = random.Random(5)
    sizes = [("a", rng.randint(10, 50)) for _ in range(4000)] + [("a", 20_000)] * 40 + [("b", 300)] * 1500
    docs = spark.createDataFrame([(i, n, s) for i, (s, n) in enumerate(sizes)], "doc_id long, n int, source string").selectExpr("doc_id", "repeat('w ', n) as text", "source")
    rows = mixing.mix(docs, n_shards=4, block_rows=64).select("doc_id", "source", "size", "target", "taken", "copies").collect()
    taken, target = sum(r.taken for r in rows if r.source == "a"), next(r.target for r in rows if r.source == "a")
    assert abs(taken - target) <= 10
    assert all(r.taken == r.size * len({c.epoch for c in r.copies}) for r in rows)


def test_mix_deals_every_copy_once(prose):
    mixed = mixing.mix(prose, n_shards=4, block_rows=16)
    rows = mixing.shuffled(mixed, ["doc_id", "text"]).collect()
    assert len(rows) == sum(len(r.copies) for r in mixed.select("copies").collect())
    assert {r.shard for r in rows} <= set(range(4)) and len({(r.doc_id, r.epoch) for r in rows}) == len(rows)


def test_mix_splits_the_blocks_of_every_source_among_shards(spark):
    """Blocks are those of the hash order; each goes to one shard whole, shards get
    equal numbers of blocks, and each source's share of a shard follows its own."""
    from pyspark.sql import functions as F

    n, shards, per = 6000, 5, 32
    docs = spark.range(n).selectExpr("id as doc_id", "concat('a b c ', id) as text", "if(id % 3 = 0, 's', 't') as source")
    mixed = mixing.mix(docs, n_shards=shards, block_rows=per, seed=11)
    key = F.shiftrightunsigned(F.xxhash64(F.lit(11), "doc_id", "text"), 4)
    rows = mixed.select("source", key.alias("key"), F.explode("copies").alias("c"), "source_size", "target").collect()
    assert {r.c.shard for r in rows} == set(range(shards))
    home, blocks = {}, collections.Counter()
    for r in rows:
        if r.c.epoch >= int(r.target // r.source_size):
            continue  # the pass that ends at the target has blocks of single rows too
        bits = int(np.ceil(np.log2((n / 3 if r.source == "s" else 2 * n / 3) / per)))
        name = (r.source, r.c.epoch, r.key >> (60 - bits))
        if name not in home:
            blocks[r.c.shard] += 1
        assert home.setdefault(name, r.c.shard) == r.c.shard
    assert len(home) > 100
    copies = collections.Counter(r.c.shard for r in rows)
    assert max(copies.values()) < 1.3 * min(copies.values())
    of = collections.Counter((r.source, r.c.shard) for r in rows)
    share = sum(r.source == "s" for r in rows) / len(rows)
    assert all(abs(of["s", j] / copies[j] - share) < 0.2 for j in range(shards))
    by = collections.defaultdict(list)
    for r in sorted(rows, key=lambda r: r.c.order):
        by[r.c.shard].append(r.key)
    assert all(abs(np.corrcoef(np.arange(len(v)), np.array(v, dtype=float))[0, 1]) < 0.1 for v in by.values())


def test_mixing_odd_rows(odd, empty, spark):
    out = {(r.doc_id, r.text): r for r in mixing.mix(odd).collect()}
    assert out[(1, None)]["size"] == 0 and out[(2, "")].taken == 0 and len(mixing.mix(odd).collect()) == len(ODD)
    assert mixing.mix(empty).count() == 0
    same = spark.createDataFrame([(1, "a b c", "x")] * 9 + [(2, "d e f", "y")] * 9, SCHEMA)
    got = mixing.mix(same).groupBy("source").sum("taken").collect()
    assert {r.source: r["sum(taken)"] for r in got} == {"x": 18, "y": 36}
    clash = spark.createDataFrame([(1, "a b", "s", "t", 4)], "doc_id long, text string, source string, Target string, n int")
    assert mixing.mix(clash).first().n == 4


# quality


def repeats(words):
    at = collections.defaultdict(list)
    for i in range(len(words) - 2):
        at[tuple(words[i : i + 3])].append(i)
    return len({i + k for v in at.values() if len(v) > 1 for i in v for k in range(3)})


def slow_quality(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    dup = len(lines) - len(set(lines))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, repeats(words)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="ab#é \n\t\x0b ", max_size=120), min_size=1, max_size=8))
def test_quality_counts(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in quality.score(rows).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == slow_quality(texts[r.doc_id])


def test_quality_odd_rows(odd, empty, spark):
    out = quality.score(odd).collect()
    assert len(out) == len(ODD)
    for r in out:
        assert r.n_words == slow_quality(r.text)[0] and (r.kept is False or r.n_words >= 50)
    assert quality.score(empty).count() == 0 and quality.keep(empty).count() == 0
    clash = spark.createDataFrame([(1, "x", "y", "z")], "doc_id long, text string, KEPT string, lang string")
    assert quality.score(clash).first().kept is False and "KEPT" not in quality.score(clash).columns
    body = " ".join(f"the house{i} of cat{i} and dog{i}" for i in range(30))
    junk = " ".join(w + "***" for w in body.split())
    frame = spark.createDataFrame([(1, body), (2, junk)], "doc_id long, text string")
    assert [r.doc_id for r in quality.keep(frame).collect()] == [1]


# tokens and packing


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=200))
def test_ids_equal_the_tokenizers_library(text):
    e = tokens.encoder(tokens.default_path())
    assert e.fast is not None
    assert e.ids(text).tolist() == e.slow.encode(text, add_special_tokens=False).ids
    starts, ends = tokens.char_spans(text, e.ids(text), e)
    assert all(a < b for a, b in zip(starts, ends, strict=True)) and (not len(ends) or ends.max() == len(text))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["<|endoftext|>", "<|endof", "text|>", " ", "a b", "é", "\n", "<|", "|>"]), max_size=12).map("".join))
def test_special_strings_are_their_tokens(text):
    from tokenizers import Tokenizer

    e = tokens.encoder(tokens.default_path())
    want = Tokenizer.from_file(tokens.default_path()).encode(text, add_special_tokens=False).ids
    assert e.ids(text).tolist() == want and want.count(50256) == text.count("<|endoftext|>")
    starts, ends = tokens.char_spans(text, e.ids(text), e)
    assert "".join(text[a:b] for a, b, i in zip(starts, ends, want, strict=True) if i == 50256) == "<|endoftext|>" * want.count(50256)


def test_ids_are_the_same_on_both_sides_of_the_longest_run(monkeypatch):
    e = tokens.encoder(tokens.default_path())
    text = "hello <|endoftext|> wörld 12345   \n\tso " * 400
    fast = e.ids(text).tolist()
    monkeypatch.setattr(tokens, "_LONG_RUN", 100)
    assert e.ids(text).tolist() == fast


@pytest.mark.parametrize("rule", tokens.RULES)
def test_section_counts_against_brute_force(spark, rule):
    """A whole table, token by token with the library's own offsets (texts without
    characters that tokens split)."""
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(tokens.default_path())
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").distinct()
    got = collections.defaultdict(collections.Counter)
    for r in tokens.section_tokens(docs, tokens.head_and_body, rule=rule).collect():
        got[r.doc_id][r.section] += r.n_tokens
    rows, checked = docs.collect(), 0
    for r in rows:
        if r.text is None or not r.text.isascii():
            continue
        checked += 1
        bounds, want = tokens.head_and_body(r.text), collections.Counter()
        for a, b in lib.encode(r.text, add_special_tokens=False).offsets:
            inside = [sum(lo <= k < hi for k in range(a, b)) for (_, lo), hi in zip(bounds, [*[x for _, x in bounds[1:]], len(r.text)], strict=True)]
            held = [k for k, n in enumerate(inside) if n]
            at = {"start": held[0], "end": held[-1], "most": inside.index(max(inside))}[rule]
            want[bounds[at][0]] += 1
        assert +got[r.doc_id] == +want
    assert checked > 50


def test_attribution_rules():
    starts, ends, bounds = np.array([0, 2, 5]), np.array([2, 5, 6]), np.array([0, 3])
    assert tokens.attribute(starts, ends, bounds, "start").tolist() == [0, 0, 1]
    assert tokens.attribute(starts, ends, bounds, "end").tolist() == [0, 1, 1]
    assert tokens.attribute(starts, ends, bounds, "most").tolist() == [0, 1, 1]
    assert tokens.attribute(np.array([2]), np.array([4]), bounds, "most").tolist() == [0]


def test_section_counts_add_up(odd, empty, prose):
    e = tokens.encoder(tokens.default_path())
    out = tokens.section_tokens(odd, tokens.head_and_body).collect()
    total = collections.Counter()
    for r in out:
        total[r.doc_id] += r.n_tokens
    assert total[6] == len(e.ids(LONG)) and total[1] == 0 and total[5] == 2 * len(e.ids("twice the same"))
    assert tokens.section_tokens(empty, tokens.head_and_body).count() == 0
    with pytest.raises(ValueError):
        tokens.section_tokens(odd, tokens.head_and_body, rule="none")


def best(items, size):
    items, found = sorted(items, reverse=True), [len(items)]

    def place(i, bins):
        if len(bins) >= found[0]:
            return
        if i == len(items):
            found[0] = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + items[i] <= size and bins[k] not in bins[:k]:
                place(i + 1, [*bins[:k], bins[k] + items[i], *bins[k + 1 :]])
        place(i + 1, [*bins, items[i]])

    place(0, [])
    return found[0]


@settings(max_examples=150, deadline=None)
@given(st.sampled_from([7, 10, 24, 50]).flatmap(lambda n: st.tuples(st.just(n), st.lists(st.integers(1, n), min_size=1, max_size=9))))
def test_bin_completion_is_optimal_on_small_tables(case):
    size, items = case
    counts = dict(collections.Counter(items))
    found, got = packing.bin_completion(counts, size), collections.Counter()
    for pattern, n in found.items():
        assert sum(x * k for x, k in pattern) <= size
        for x, k in pattern:
            got[x] += k * n
    assert got == collections.Counter(items)
    assert packing.lower_bound(counts, size) <= sum(found.values()) == best(items, size)


@pytest.mark.parametrize("seed", [3, 6, 17])
def test_bin_completion_searches_all_fillings_of_many_lengths(seed):
    rng, counts = random.Random(seed), collections.Counter()
    size, bins, parts = rng.choice([240, 400, 1000]), rng.choice([16, 20, 30]), rng.choice([3, 4])
    for _ in range(bins):
        cuts, times = sorted(rng.sample(range(1, size), parts - 1)), rng.choice([1, 1, 2])
        for a, b in zip([0, *cuts], [*cuts, size], strict=True):
            counts[b - a] += times
    assert len(counts) > 40
    found = packing.bin_completion(dict(counts), size, nodes=1000)
    # Made of full bins, so the fill bound is the optimum.
    assert sum(found.values()) == packing.lower_bound(dict(counts), size) == sum(x * c for x, c in counts.items()) // size


def test_the_quick_search_keeps_its_path_alone():
    """Steps that wait to be tried are a filling each, not a copy of all counts."""
    rng = random.Random(5)
    counts = {x: rng.randint(1, 40) for x in range(40, 2049)}
    assert sum(packing.best_fit(counts, 2048).values()) > packing.lower_bound(counts, 2048)  # so there is something to search
    tracemalloc.start()
    found = packing._first_packing(counts, 2048, 600)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    got = collections.Counter()
    for pattern, n in found.items():
        for x, k in pattern:
            got[x] += k * n
    assert got == collections.Counter(counts)
    assert peak < 20e6


def test_packing_is_whole(prose, odd, empty):
    docs = prose.unionByName(odd)
    out = packing.pack(docs, size=256).toPandas().sort_values(["sequence_id", "offset"])
    e = tokens.encoder(tokens.default_path())
    assert (out.groupby("sequence_id").length.cumsum() - out.length == out.offset).all()
    assert out.groupby("sequence_id").length.sum().max() <= 256
    want = collections.Counter()
    for r in docs.collect():
        ids = [*e.ids(r.text or "").tolist(), 0]
        first = len(ids) % 256 or 256
        edges = [0, *range(first, len(ids) + 1, 256)]
        for k in range(len(edges) - 1):
            part = ids[edges[k] : edges[k + 1]]
            want[(r.doc_id, k, edges[k], zlib.crc32(np.array(part, dtype="<u4").tobytes()))] += 1
    ids = out.doc_id.astype(object).where(out.doc_id.notna(), None)
    got = collections.Counter(zip([None if i is None else int(i) for i in ids], out.piece, out.start, out.ids_crc32, strict=True))
    assert got == want
    assert out.sequence_id.nunique() <= packing.lower_bound(dict(collections.Counter(out.length)), 256) + 1
    assert packing.pack(empty).count() == 0
    whole = packing.sequences(packing.pack(odd, size=64)).collect()
    assert all(len(r.ids) <= 64 for r in whole) and sum(len(r.ids) for r in whole) == sum(len(e.ids(t or "")) + 1 for _, t, _ in ODD)


# toxicity


def test_toxicity_on_held_out_texts(spark, empty, odd):
    rng = random.Random(5)
    plain = [f"calm{i}word" for i in range(400)]

    def text(toxic):
        words = [rng.choice(plain) for _ in range(rng.randint(30, 90))]
        for _ in range(rng.randint(2, 9) if toxic else 0):
            words[rng.randrange(len(words))] = rng.choice(["idioty", "vilething", "scumlord"])
        return " ".join(words)

    rows = [(i, text(i % 8 == 0), int(i % 8 == 0)) for i in range(600)]
    docs = spark.createDataFrame([(i, t, "s") for i, t, _ in rows], SCHEMA)
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows if i < 400] + [(None, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, labels)
    out = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    held = [(out[i], y) for i, _, y in rows if i >= 400]
    assert sum(r.toxic == bool(y) for r, y in held) >= 0.97 * len(held)
    assert all(a <= b for a, b in zip(model.cuts, model.cuts[1:], strict=False))
    more = model.expected("calm1word idioty") < model.expected("idioty vilething scumlord " * 5) <= 3
    assert more and {r.doc_id for r in toxicity.keep(docs, model).collect()} == {i for i, r in out.items() if not r.toxic}
    assert toxicity.score(empty, model).count() == 0 and toxicity.score(odd, model).filter("severity is null").count() == 0
    none = toxicity.train(empty, labels)
    assert none.weights == {} and toxicity.keep(docs, none).count() == 600


# near duplicates


def slow_fingerprint(text, size=3):
    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    runs = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    h = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aAéÉ \t\n b", max_size=60))
def test_fingerprint(text):
    assert simhash.fingerprint(text) == slow_fingerprint(text)


def brute(fps, radius):
    parent = list(range(len(fps)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = top(i), top(j)
                parent[max(a, b)] = min(a, b)
    return [top(i) for i in range(len(fps))]


@pytest.mark.parametrize("reach", [1, 3])
def test_neighbours_meet_in_a_leaf_that_one_of_them_lives_in(reach):
    rng = np.random.default_rng(reach)
    x = rng.integers(0, 1 << 32, 3000, dtype=np.uint64)
    y = x.copy()
    for _ in range(reach):
        y ^= np.uint64(1) << rng.integers(0, 32, len(x), dtype=np.uint64)
    points = simhash.vantage_points(1, 9)
    where = []
    for part in (x, y):
        rows, leaf, home = simhash.tree_leaves(part, points, reach)
        assert home.sum() == len(part) and len(rows) > len(part)
        where.append((leaf[home][np.argsort(rows[home])], set(zip(rows.tolist(), leaf.tolist(), strict=True))))
    (own_x, all_x), (own_y, all_y) = where
    apart = sum(a != b for a, b in zip(own_x.tolist(), own_y.tolist(), strict=True))
    assert apart > 500  # so boundaries that overlap are needed
    assert all((i, b) in all_x or (i, a) in all_y for i, (a, b) in enumerate(zip(own_x.tolist(), own_y.tolist(), strict=True)))


@pytest.mark.parametrize(("leaf_rows", "leaf"), [(20, 256), (50_000, 256), (50_000, 4), (20, 16)])
def test_links_against_brute_force(spark, leaf_rows, leaf):
    from evgraph.llm.components import components

    rng = random.Random(8)
    fps = {rng.getrandbits(64) for _ in range(60)}
    centre = rng.getrandbits(64)
    for _ in range(150):  # one dense group, and a chain that leads away from it
        x = centre
        for _ in range(rng.randint(0, 4)):
            x ^= 1 << rng.randrange(64)
        fps.add(x)
    chain = centre
    for _ in range(12):
        chain ^= 0b111 << rng.randrange(60)
        fps.add(chain)
    fps = sorted(fps)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    frame = spark.createDataFrame([(x,) for x in signed], "fingerprint long")
    roots = {r.node: r.root for r in components(simhash.fingerprint_links(frame, 3, leaf_rows, leaf=leaf)).collect()}
    want = brute(fps, 3)
    got = collections.defaultdict(set)
    for x in signed:
        got[roots.get(x, x)].add(x)
    groups = collections.defaultdict(set)
    for x, w in zip(signed, want, strict=True):
        groups[w].add(x)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, groups.values()))


def test_near_duplicates_odd_rows(spark, odd, empty):
    out = simhash.near_duplicates(odd).collect()
    assert len(out) == len(ODD)
    blank = [r for r in out if r.fingerprint == "0" * 16]
    assert {r.doc_id for r in blank} == {1, 2, 3} and {r.component_id for r in blank} == {1}
    assert simhash.near_duplicates(empty).count() == 0
    for r in out:
        assert int(r.fingerprint, 16) == slow_fingerprint(r.text)
    clash = spark.createDataFrame([(1, "a b", "x", 3)], "doc_id long, text string, FINGERPRINT string, component_id int")
    assert simhash.near_duplicates(clash).first().component_id == 1


def jaccard(a, b, size=5):
    x, y = ({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} for w in (a.lower().split(), b.lower().split()))
    return len(x & y) / len(x | y)


def test_pairs_at_the_similarity_are_found(spark):
    """Pairs of a similarity of exactly 0.8, and of just below."""
    rng = random.Random(11)
    rows, pairs = [], 400
    for k in range(pairs):
        words = [f"w{rng.randrange(10**7)}" for _ in range(184)]
        swapped = 20 if k % 2 == 0 else 21
        other = words[:-swapped] + [f"v{rng.randrange(10**7)}" for _ in range(swapped)]
        rows += [(2 * k, " ".join(words), "s"), (2 * k + 1, " ".join(other), "s")]
    assert jaccard(rows[0][1], rows[1][1]) == 0.8 > jaccard(rows[2][1], rows[3][1])
    kept = {r.doc_id for r in simhash.first_of_each(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all({2 * k, 2 * k + 1} <= kept for k in range(1, pairs, 2))
    assert sum(2 * k + 1 not in kept for k in range(0, pairs, 2)) >= 0.97 * pairs / 2


@pytest.mark.parametrize("most", [8, 40, 512])
def test_large_groups_against_brute_force(spark, most):
    """A crowded group of near copies with members that only chains connect, and some
    that nothing does, cut into chunks of several sizes."""
    rng = random.Random(12)
    base = [f"t{rng.randrange(10**6)}" for _ in range(200)]

    def edited(words, n):
        out = list(words)
        for i in rng.sample(range(len(out)), n):
            out[i] = f"e{rng.randrange(10**6)}"
        return out

    texts = [edited(base, rng.choice([0, 1, 2, 3])) for _ in range(90)]
    chain = edited(base, 2)
    for _ in range(8):
        at = rng.randrange(0, 185)
        chain = chain[:at] + [f"c{rng.randrange(10**6)}" for _ in range(8)] + chain[at + 8 :]
        texts.append(chain)
    texts += [edited(base, 12) for _ in range(12)]
    texts = [" ".join(t) for t in texts]
    parent = list(range(len(texts)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if jaccard(texts[i], texts[j]) >= 0.8:
                a, b = top(i), top(j)
                parent[max(a, b)] = min(a, b)
    group = spark.createDataFrame([(7, i, t) for i, t in enumerate(texts)], "root long, id long, text string")
    from evgraph.llm.components import components

    got = {r.node: r.root for r in components(simhash._verified(group, 5, 0.8, most)).collect()}
    want = [top(i) for i in range(len(texts))]
    assert len(set(want)) > 3
    assert [got.get(i, i) for i in range(len(texts))] == want


def test_bands_grow_with_the_texts():
    few, many = simhash._bands(1000), simhash._bands(10**9)
    assert few.shape == (63, 16) and many.shape[1] == 28 and len(many) > 400


@pytest.mark.parametrize(("most", "deal"), [(10**6, 10**6), (10**6, 40), (150, 10**6), (100, 40)])
def test_candidates_are_neighbours_in_a_part_not_equal_in_it(spark, most, deal):
    """Pairs in which few parts are equal, and a group of near copies, against brute force."""
    from evgraph.llm.components import components

    rng = np.random.default_rng(21)
    bits = rng.integers(0, 2, (1300, 256), dtype=np.uint8)
    for k in range(0, 1000, 2):  # pairs that differ in 64 bits
        bits[k + 1] = bits[k]
        bits[k + 1, rng.permutation(256)[:64]] ^= 1
    bits[1050:] = bits[1050]
    for k in range(1051, 1300):
        bits[k, rng.permutation(256)[: rng.integers(1, 30)]] ^= 1
    wide = np.packbits(bits, axis=1, bitorder="little").view(np.int64)
    frame = spark.createDataFrame([(i, *map(int, w)) for i, w in enumerate(wide)], "id long, f0 long, f1 long, f2 long, f3 long")
    found = components(simhash._candidates(frame, most, deal)).collect()
    got = np.arange(len(bits))
    for r in found:
        got[r.node] = r.root
    assert sum(got[k + 1] == k for k in range(0, 1000, 2)) >= 280  # 200 have a part in common by ``_bands(1300)``

    parent = list(range(len(bits)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    near = np.zeros((len(bits), len(bits)), dtype=bool)
    for at in simhash._bands(len(bits), 1):
        near |= (bits[:, None, at] ^ bits[None, :, at]).sum(axis=2, dtype=np.uint8) <= 1
    for i, j in np.argwhere(np.triu(near, 1)).tolist():
        if (bits[i] ^ bits[j]).sum() <= simhash.WIDE_RADIUS:
            a, b = top(i), top(j)
            parent[max(a, b)] = min(a, b)
    assert got.tolist() == [top(i) for i in range(len(bits))]


def test_first_of_each_keeps_one(spark, empty, odd):
    rng = random.Random(2)
    base = [f"tok{rng.randrange(5000)}" for _ in range(300)]
    edit = lambda n: " ".join("new" + str(rng.random()) if i in set(rng.sample(range(300), n)) else w for i, w in enumerate(base))
    rows = [(10, " ".join(base), "s"), (4, " ".join(base), "s"), (11, edit(2), "s"), (12, edit(4), "s"), (13, edit(150), "s"), (14, None, "s"), (15, "", "t")]
    rows += [(100 + i, " ".join(f"o{rng.randrange(10**6)}" for _ in range(80)), "s") for i in range(20)]
    kept = {r.doc_id for r in simhash.first_of_each(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert kept == {4, 13, 14} | {100 + i for i in range(20)}
    assert simhash.first_of_each(empty).count() == 0
    assert sorted(str(r.doc_id) for r in simhash.first_of_each(odd).collect()) == sorted(["1", "None", "5", "6", "7"])


def test_length_does_not_hide_a_passage(spark):
    rng = random.Random(4)
    calm = lambda n: " ".join(rng.choice(["river", "stone", "paper", "walk", "green", "house"]) for _ in range(n))
    vile = lambda n: " ".join(rng.choice(["vile", "scum", "filth"] if rng.random() < 0.2 else ["river", "stone"]) for _ in range(n))
    rows = [(i, vile(80) if i % 5 == 0 else calm(80)) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(400)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    assert model.expected(vile(80)) >= 0.5 > model.expected(calm(20_000))
    for where in (0, 4321, 9999):
        words = calm(10_000).split()
        words[where:where] = vile(80).split()
        assert model.expected(" ".join(words)) >= 0.5
    by_hand = max(
        sum(model.weights.get(f, 0.0) * toxicity.weighed(c, 200) for f, c in toxicity.features_of(collections.Counter(words[a : a + 200])).items())
        for a in [*range(0, len(words) - 200, 100), len(words) - 200]
    )
    assert model.expected(" ".join(words)) == pytest.approx(sum(toxicity._sigmoid(by_hand - c) for c in model.cuts))


def test_grades_come_from_the_other_fold():
    texts = [{"vile": 2.0}, {"vile": 1.0}, {"own": 9.0}, {}] * 20
    toxic = np.array([1, 1, 1, 0] * 20)
    fold = np.arange(80) // 40
    fold[2::4] = 0
    got = toxicity.grades(texts, toxic, 2, fold)
    # Nothing outside their fold says that "own" marks toxic texts.
    assert got[0] == 2 and got[1] == 1 and got[2] == 1 and got[3] == 0


def test_toxicity_samples_labels_of_documents_that_are_there(spark):
    docs = spark.createDataFrame([(i, "vile " * 5 if i % 2 else "calm day " * 5) for i in range(40)], "doc_id long, text string")
    labels = spark.range(4000).selectExpr("id as doc_id", "int(id % 2) as toxic")
    model = toxicity.train(docs, labels, sample_rows=40)
    assert "vile" in model.weights
    with pytest.warns(UserWarning, match="no text is labelled toxic"):
        toxicity.train(docs, labels.filter("toxic = 0"), sample_rows=40)
