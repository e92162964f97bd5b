"""Operators on pages, conversations and vectors, and the pipeline."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from evgraph.llm import chat, embeddings, html
from evgraph.llm.components import components
from hypothesis import given, settings
from hypothesis import strategies as st

# pages

PAGE = """<!DOCTYPE html><html><head><title>no</title><style>p{}</style><script>var a="</p><p>no";</script></head><body>
<header><div class="logo">no</div></header><nav><ul><li><a href="/">no</a></li></ul></nav>
<div class="cookie-notice">no notice</div><main><article><h1>Title &amp;  more</h1>
<p>First&nbsp;para with <b>bold</b> and <a href=x>a link</a>.<br>second   line</p>
<aside>no aside</aside><p>caf&eacute; &#x41; &lt;b&gt; &amp;amp;<form><input><button>no</button><label>no</label></form>
<p>Unclosed <i>para<p>Last one</article></main>
<section id="comments"><article><p>no comment at all from a reader who writes a lot here</p></article></section>
<footer>no</footer></body></html>"""


def test_main_text():
    assert html.main_text(PAGE).split("\n") == [
        "Title & more", "First para with bold and a link. second line", "café A <b> &amp;", "Unclosed para", "Last one",
    ]


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""), ("", ""), ("just text", "just text"), ("<p>a<p>b", "a\nb"), ("<p>cut off <b", "cut off"), ("<article><p>x</p>", "x"),
        ("<!-- <p>no</p> --><p>yes</p><!-- open", "yes"), ("<script>never closed <p>x", ""), ("<p title='a>b'>q</p>", "q"), ("1 < 2 and 3 > 2", "1 < 2 and 3 > 2"),
    ],
)
def test_broken_pages(page, text):
    assert html.main_text(page) == text


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<p title='a hidden gem'>shown</p><p hidden>no</p><p style='color: red; display : none'>no</p><p aria-hidden=true>no</p>", "shown"),
        ("<p data-x='hidden'>a</p><p class=hidden-menu-open>b</p>", "a\nb"),
        ("<div class='entry share'>" + "word " * 60 + "</div>", ("word " * 60).strip()),
        ("<article class='post no-sidebar'><header><h1>Own title</h1></header><p>x</p><div class=post-comments><p>no</p></div></article>", "Own title\nx"),
        ("<div role=navigation><p>no</p></div><div id=mainContent><p>x</p></div><div class=comment-body><p>" + "no " * 50 + "</p></div>", "x"),
    ],
)
def test_what_markup_says(page, text):
    assert html.main_text(page) == text


@pytest.mark.parametrize(
    ("name", "says"),
    [("entry-content", 1), ("mainContent", 1), ("post-comments", -1), ("comment-body", -1), ("no-sidebar", 0), ("sidebar-layout", 0), ("gem", 0), ("article-header", 0), ("site-footer", -1), ("tags", 0), ("", 0), ("42", 0)],
)
def test_names(name, says):
    assert html.named(name) == says


def split_on(node):
    return set() if node.feature < 0 else {(html.SIZES + html.NAMES)[node.feature]} | split_on(node.low) | split_on(node.high)


def test_the_tree_decides_by_sizes_and_densities_of_neighbours():
    tree = html.trained()
    assert {"words", "density", "density_before1", "density_after1", "words_after1", "density_before2"} <= split_on(tree)

    assert tree.feature < len(html.SIZES) and max(tree.low.feature, tree.high.feature) < len(html.SIZES)


def test_the_tree_separates_layouts_of_other_lengths():
    rng, right, silent = np.random.default_rng(99), [], []
    for page in html.LABELLED:
        for _ in range(10):
            markup, labels = html.laid_out(page, rng)
            found = html.blocks(markup)
            same = [html.accept(html.trained(), r) == y for r, y in zip(html.features(found), labels, strict=True)]
            right += same
            if all(b.part == 0 for b in found):
                silent += same
    assert np.mean(right) >= 0.98 and np.mean(silent) >= 0.97


def test_plain_pages_without_any_name():
    """Three hand-labelled pages whose markup names no part."""
    prose = lambda n: " ".join(f"w{i}" for i in range(n))
    link = lambda n: "<a href=x>" + prose(n) + "</a>"
    menu = "".join(f"<div>{link(n)}</div>" for n in (1, 2, 1, 3))
    news = [prose(7), prose(31), prose(54) + " " + link(2), prose(9), prose(40)]
    page = f"<body>{menu}<h1>{news[0]}</h1>" + "".join(f"<p>{x}</p>" for x in news[1:]) + f"<div>{link(6)}</div><div>{link(9)}</div><div>{link(5)}</div>"
    assert html.main_text(page) == "\n".join(x.replace("<a href=x>", "").replace("</a>", "") for x in news)
    table = f"<table><tr><td>{link(2)}<td>{link(1)}<tr><td>{link(3)}<tr><td>{prose(80)}<tr><td>{prose(33)}<tr><td>{link(4)}<td>{link(2)}</table>"
    assert html.main_text(table) == prose(80) + "\n" + prose(33)
    teasers = menu + f"<h2>{prose(8)}</h2><p>{prose(66)}</p><p>{prose(21)}</p><ul>" + "".join(f"<li>{link(n)}</li>" for n in (7, 12, 9)) + "</ul>"
    assert html.main_text(teasers) == "\n".join(prose(n) for n in (8, 66, 21))


def test_deep_pages_take_time_in_proportion():
    import time

    def took(n):
        start = time.process_time()
        html.main_text("<div>" * n + "x " * 50 + "</p>" * n + "<b>" * n + "<p>x" * n + "</i></div>" * n)
        return time.process_time() - start

    took(1000)
    assert took(80_000) < 40 * max(took(8000), 0.02)


def test_extract_against_a_parser(spark):
    """All pages of a table against the standard library's parser, which takes the
    article of this one layout by its tags."""
    from html.parser import HTMLParser

    class Article(HTMLParser):
        def __init__(self):
            super().__init__()
            self.deep, self.text = 0, [""]

        def handle_starttag(self, tag, attrs):
            self.deep += tag == "article"
            if tag == "br":
                self.text[-1] += " "
            elif tag not in ("b", "i", "a"):
                self.text.append("")

        def handle_endtag(self, tag):
            self.deep -= tag == "article"
            if tag not in ("b", "i", "a"):
                self.text.append("")

        def handle_data(self, data):
            if self.deep:
                self.text[-1] += data

    def want(page):
        p = Article()
        p.feed(page)
        p.close()
        return "\n".join(" ".join(t.split()) for t in p.text if t.strip())

    rows = html.extract(spark.read.parquet("/root/testdata/sf0.01/pages.parquet").withColumnRenamed("text", "old")).collect()
    assert len(rows) == 250 and all(r.text == want(r.html) for r in rows)


def test_sizes_decide_where_names_are_taken_out(spark):
    """All pages of a table with every name gone give the same texts, by a tree fitted to
    some pages that had them."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    tree = html.train(pages, sample_pages=150)
    assert tree == html.train(pages.repartition(7), sample_pages=150)
    found = [r.html for r in pages.collect()]
    mute = [re.sub(r"<(/?)(nav|article|footer)\b", r"<\1div", x).replace('class="ad"', "") for x in found]
    assert all(b.part == 0 for x in mute for b in html.blocks(x))
    assert [html.main_text(x, tree) for x in mute] == [html.main_text(x, tree) for x in found]


def test_parts_that_names_get_wrong():
    words = lambda n: " ".join(f"w{i}" for i in range(n))
    item = "<li><a href=x>{}</a></li>".format
    links = "<main><h1>A b c d</h1><ul>" + "".join(item(words(n)) for n in (2, 2, 3, 2, 1, 2, 2, 2)) + f"</ul><p>{words(60)}</p><p>{words(40)}</p></main><footer>{words(9)}</footer>"
    assert html.main_text(links).split("\n")[-2:] == [words(60), words(40)] and "w0 w1 w2\n" not in html.main_text(links)
    comment = f"<article><h1>A b c d e</h1><p>{words(60)}</p><p>{words(33)}</p></article><article class='comment'><p>{words(29)}</p></article><footer>{words(9)}</footer>"
    assert html.main_text(comment) == "\n".join(["A b c d e", words(60), words(33)])
    ends = f"<nav><ul>{item(words(2))}{item(words(1))}{item(words(2))}</ul></nav><article><h1>A b c d e</h1><p>{words(50)}</p><p>{words(12)}</p><p>{words(31)}</p></article>"
    assert html.main_text(ends) == "\n".join(["A b c d e", words(50), words(12), words(31)])
    odd = f"<article><h1>A b c d e f</h1><p>{words(52)}</p><div class=share-price><p>{words(50)}</p></div><p>{words(33)}</p><p>{words(41)}</p></article>"
    assert html.main_text(odd) == "\n".join(["A b c d e f", words(52), words(50), words(33), words(41)])


def test_extract_odd_rows(spark):
    pages = spark.createDataFrame([(1, "u", None, "old"), (1, "u", PAGE, "old"), (None, None, "<p>" + "x " * 200_000, None)], "page_id long, url string, html string, TEXT string")
    out = html.extract(pages).collect()
    assert sorted(len(r.text) for r in out) == [0, len(html.main_text(PAGE)), 399_999]
    assert html.extract(pages.limit(0)).count() == 0 and "TEXT" not in html.extract(pages).columns


# conversations

TRICKY = st.text(alphabet="<>/s\\ab\n[]INST é", max_size=40) | st.sampled_from(["</s>", "<s>", "<\\s>", "<\\\\/s>", "</s>[INST] ok [/INST]", "<", "<s", "\\"])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet="usn<>/\\\n", max_size=8), TRICKY), max_size=6))
def test_round_trip(turns):
    shown = "".join(chat.render(r, t) for r, t in turns)
    back = chat.parse(shown)
    assert [(t.role, t.text) for t in back] == turns
    assert [chat.unescape(shown[t.start : t.end]) for t in back] == [t for _, t in turns]


@settings(max_examples=200, deadline=None)
@given(TRICKY)
def test_escape_is_reversible(text):
    assert chat.unescape(chat.escape(text)) == text and chat.OPEN not in chat.escape(text)


@pytest.mark.parametrize("bad", ["x", "<s>user", "<s>user\nno end", "<s>a\n<s>b\nc</s>", "<s>a\nb</s>rest"])
def test_parser_refuses(bad):
    with pytest.raises(chat.GrammarError):
        chat.parse(bad)


@pytest.mark.parametrize("segment", [1, 30, 1 << 20])
def test_digests(spark, segment):
    rows = [(1, 0, "user", "hi</s>"), (1, 1, "assistant", "<s>yo é"), (1, 2, None, None), (None, 0, "user", "x"), (2, None, "assistant", ""), (1, 1, "assistant", "<s>yo é"), (3, 5, "a\nb", "t" * 5000)]
    frame = spark.createDataFrame([(*r, "other") for r in rows], "conv_id long, turn long, role string, text string, Segment string")
    out = {r.conv_id: r for r in chat.read_back(chat.format_conversations(frame, segment_chars=segment)).collect()}
    groups = collections.defaultdict(list)
    for c, n, r, t in rows:
        groups[c].append((n is not None, n or 0, r or "", t or ""))
    assert set(out) == set(groups)
    for c, turns in groups.items():
        turns.sort()
        said = "".join(t for _, _, r, t in turns if r == "assistant")
        assert out[c].n_turns == len(turns) and out[c].loss_chars == len(said)
        assert out[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for _, _, r, t in turns).encode()).hexdigest()
        assert out[c].loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert out[c].formatted_chars == sum(len(chat.render(r, t)) for _, _, r, t in turns)
    assert chat.read_back(chat.format_conversations(frame.limit(0))).count() == 0


def test_roles_with_line_ends_and_rows_out_of_order(spark):
    turns = [(1, 0, "sys\ntem", "a"), (1, 1, "assistant", "b" * 50), (1, 2, "<n>", "c" * 50)]
    frame = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    made = chat.format_conversations(frame, segment_chars=20)
    row = chat.read_back(made).first()
    assert row.turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for _, _, r, t in turns).encode()).hexdigest()
    assert made.count() > 1
    with pytest.raises(Exception, match="is due"):
        chat.read_back(made.orderBy("segment", ascending=False).coalesce(1)).collect()


# vectors


def test_e8_points_are_nearest():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 8)) * 2
    found = embeddings.nearest_e8(x) / 2
    assert ((found % 1 == 0).all(axis=1) | (found % 1 == 0.5).all(axis=1)).all() and (found.sum(axis=1) % 2 == 0).all()
    roots = [v for v in np.array(np.meshgrid(*[[-1, 0, 1]] * 8)).T.reshape(-1, 8) if (v**2).sum() == 2]
    halves = np.array(np.meshgrid(*[[-0.5, 0.5]] * 8)).T.reshape(-1, 8)
    steps = np.concatenate([roots, halves[(halves.sum(axis=1) % 2) == 0]])
    assert len(steps) == 240
    own = ((x - found) ** 2).sum(axis=1)
    near = np.stack([((x - found - s) ** 2).sum(axis=1) for s in steps])
    assert (own <= near.min(axis=0) + 1e-9).all()


def exact(vectors, cosine):
    unit = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    close = unit @ unit.T >= cosine
    np.fill_diagonal(close, False)
    return close


@pytest.mark.parametrize("most", [8, 4096])
def test_links_and_recall(spark, most):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(150, 64))
    near = np.concatenate([base[i % 30] + rng.normal(size=64) * rng.choice([0.1, 0.2, 0.3]) for i in range(200)]).reshape(-1, 64)
    vectors = np.concatenate([base, near, base[:1].repeat(25, axis=0), 3 * base[1:2]])
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    random.Random(1).shuffle(rows)
    out = {r.vec_id: r for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), most=most).collect()}
    close = exact(vectors, 0.95)
    found = sum(r.n_links for r in out.values())
    assert all(out[i].n_links <= close[i].sum() for i in range(len(vectors))) and found >= 0.98 * close.sum()
    label = np.arange(len(vectors))
    while True:
        new = np.array([min([label[i], *label[close[i]]]) for i in range(len(label))])
        if (new == label).all():
            break
        label = new
    assert np.mean([out[i].component_id == label[i] for i in range(len(label))]) >= 0.98
    assert all(out[i].kept == (out[i].component_id == i) for i in out)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0, 2.0]), (7, [1.0, 2.0]), (8, [2.0, 4.0]), (9, [1.0, 2.0, 3.0]), (None, [1.0, 2.0]), (10, [1e200, 2e200]), (11, [-0.0, 1.0]), (12, [0.0, 1.0])]
    frame = spark.createDataFrame([(*r, True) for r in rows], "vec_id long, embedding array<double>, KEPT boolean")
    out = collections.defaultdict(list)
    for r in embeddings.near_duplicates(frame).collect():
        out[r.vec_id].append(r)
    assert sum(map(len, out.values())) == len(rows)
    for i in (1, 2, 3, 4, 5, 6, 9):
        assert (out[i][0].n_links, out[i][0].component_id, out[i][0].kept) == (0, i, True)
    assert [r.n_links for r in out[7]] == [4, 4] and out[8][0].component_id == 7 and out[None][0].component_id == 7
    assert out[10][0].n_links == 4 and out[12][0].component_id == 11
    assert embeddings.near_duplicates(frame.limit(0)).count() == 0
    floats = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert [r.n_links for r in embeddings.near_duplicates(floats).collect()] == [1, 1]


@pytest.mark.parametrize("dims", [64, 16])
def test_recall_at_exactly_the_limit(spark, dims):
    """Pairs at a cosine of 0.95 (and a hair more, for rounding): the hardest that count."""
    rng = np.random.default_rng(dims)
    n = 500
    a = rng.normal(size=(n, dims))
    a /= np.linalg.norm(a, axis=1)[:, None]
    side = rng.normal(size=(n, dims))
    side -= (side * a).sum(axis=1)[:, None] * a
    side /= np.linalg.norm(side, axis=1)[:, None]
    cosine = 0.95 + 1e-12
    b = (cosine * a + np.sqrt(1 - cosine**2) * side) * rng.uniform(0.1, 9, size=(n, 1))
    vectors = np.concatenate([a, b])
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    close = exact(vectors, 0.95)
    out = {r.vec_id: r for r in embeddings.near_duplicates(frame).collect()}
    assert all(out[i].n_links <= close[i].sum() for i in range(2 * n))
    found = sum(out[i].component_id == out[i + n].component_id for i in range(n))
    assert found >= 0.97 * n


def test_many_vector_lengths(spark):
    rows = [(i * 10 + k, [1.0 + (k == 2)] + [1.0] * i) for i in range(1, 1100, 7) for k in range(2)]
    out = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert len(out) == len(rows) and all(r.n_links == 1 and r.component_id == r.vec_id // 10 * 10 for r in out)


@pytest.mark.parametrize("chunk", [500_000, 40])
def test_components(spark, chunk):
    rng = random.Random(6)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 200 + i) for i in range(50)] + [(5, 5), (60, 0), (300, 301), (301, 300)]
    edges += [(rng.randrange(1000, 1400), rng.randrange(1000, 1400)) for _ in range(250)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long").repartition(9), chunk=chunk).collect()}
    label = {x: x for e in edges for x in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    assert all(got.get(x, x) == root for x, root in label.items())
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
    if chunk < len(edges):
        with pytest.raises(RuntimeError, match="not settled"):
            components(spark.createDataFrame(edges, "a long, b long"), rounds=1, chunk=chunk)


# pipeline


def test_pipeline_against_brute_force(spark):
    """Every stage on what the one before it kept of a whole table."""
    import corpus_pipeline as cp
    import duckdb
    from evgraph.llm import mixing, oracles, toxicity
    from evgraph.llm.common import stage

    at = "/root/testdata/sf0.01"
    docs = cp.read(spark, at, "documents")
    base = duckdb.connect()
    base.execute(f"create view documents as select * from '{at}/documents.parquet'")
    fine = {r[0] for r in base.execute(f"select doc_id from ({oracles.QUALITY}) where kept").fetchall()}
    kept = stage(cp.quality_rules(spark, docs, at), "kept")
    assert {r.doc_id for r in kept.select("doc_id").collect()} == fine and kept.columns == docs.columns

    model = toxicity.train(kept, cp.read(spark, at, "labels"))
    clean = stage(cp.toxic_text(spark, kept, at), "clean")
    rows = {r.doc_id: r for r in clean.collect()}
    assert set(rows) == {r.doc_id for r in kept.collect() if model.expected(r.text) < 0.5}

    def shingles(text):
        w = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))

    sets = {i: shingles(r.text) for i, r in rows.items()}
    holds = collections.defaultdict(list)
    for i, x in sets.items():
        for g in x:
            holds[g].append(i)
    both = collections.Counter()
    for ids in holds.values():
        for k, i in enumerate(ids):
            for j in ids[:k]:
                both[min(i, j), max(i, j)] += 1
    parent = {i: i for i in sets}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for (i, j), n in both.items():
        if 10 * n >= 8 * (len(sets[i]) + len(sets[j]) - n):
            a, b = top(i), top(j)
            parent[max(a, b)] = min(a, b)
    want = {i for i in sets if top(i) == i}
    single = stage(cp.near_duplicates(spark, clean, at), "single")
    got = {r.doc_id for r in single.select("doc_id").collect()}
    assert want <= got and len(got) <= 1.01 * len(want) and len(want) < len(sets)

    mixed = cp.source_mix(spark, single, at).select("doc_id", "source", "text").collect()
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0d]+", t or ""))
    left = [rows[i] for i in sorted(got)]
    names = sorted({r.source for r in left if r.source is not None}) + ([None] if any(r.source is None for r in left) else [])
    sizes = np.array([sum(words(r.text) for r in left if r.source == s) for s in names])
    goal = mixing.targets(sizes, np.array([1 + i % 3 for i in range(len(names))], dtype=float))
    for s, g in zip(names, goal, strict=True):
        longest = max(words(r.text) for r in left if r.source == s)
        assert abs(sum(words(r.text) for r in mixed if r.source == s) - g) <= longest / 2 + 1
    times = collections.Counter(r.doc_id for r in mixed)
    assert set(times) <= got and max(times.values()) <= 3

    packed = cp.best_fit_packing(spark, spark.createDataFrame([(r.doc_id, r.text) for r in mixed], "doc_id long, text string"), at).toPandas()
    assert packed.groupby("sequence_id")["length"].sum().max() <= 2048
    assert collections.Counter(packed[packed.piece == 0].doc_id) == times


def test_pipeline_stages_on_odd_rows(spark):
    import corpus_pipeline as cp

    text = " ".join(f"the w{i} of x{i} and y{i}" for i in range(40))
    rows = [(1, None, None, None, None), (None, "", "en", "s", 0), (2, text, None, None, None), (2, text, None, None, None), (None, text + " more", "en", "s", 9), (3, "long " * 50_000, "en", "t", 1), (4, text.upper(), "en", "s", 2)]
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, Severity string, FINGERPRINT string")
    kept = cp.quality_rules(spark, docs, "/root/testdata/sf0.001")
    assert kept.columns == docs.columns and kept.count() == 4
    for f in (cp.toxic_text, cp.near_duplicates, cp.source_mix):
        assert f(spark, docs, "/root/testdata/sf0.001").columns == docs.columns
    one = cp.near_duplicates(spark, kept, "/root/testdata/sf0.001").collect()
    assert [r.doc_id for r in one] == [2]
    assert cp.best_fit_packing(spark, docs, "/root/testdata/sf0.001").filter("piece = 0").count() == len(rows)


def test_pipeline_stages(spark):
    import corpus_pipeline as cp

    docs = cp.read(spark, "/root/testdata/sf0.001", "documents")
    rows = docs.count()
    for name, stage in cp.STAGES[:-1]:
        docs = cp.stage(stage(spark, docs, "/root/testdata/sf0.001"), name)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        now = docs.count()
        assert 0 < now and (now <= rows or name == "source_mix")
        rows = now
    packed = cp.STAGES[-1][1](spark, docs, "/root/testdata/sf0.001").toPandas()
    assert packed.groupby("sequence_id").length.sum().max() <= 2048
    assert (packed.piece == 0).sum() == rows


def test_pipeline_on_an_empty_table(spark):
    import corpus_pipeline as cp

    docs = cp.read(spark, "/root/testdata/sf0.001", "documents").limit(0)
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, "/root/testdata/sf0.001")
    assert docs.count() == 0
