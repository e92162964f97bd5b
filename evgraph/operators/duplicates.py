"""Blocks of lines that stand in more than one place: what counts as a line, and a
greedy cover of all repeated stretches."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evgraph.operators.health import SKIPPED, WINDOW
from evgraph.operators.traverse import connected
from evgraph.storage import stage

#: How imports in several lines begin, by how their first line ends.
OPENS_GROUP = {"(": ("import (", "from "), "{": ("import {", "import type {", "export {")}
CLOSES = {"(": ")", "{": "}"}
#: What docstrings begin and end with.
QUOTES = ('"""', "'''")
#: Ends of lines, and white space in them.
_ENDS = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"
_BLANKS = r"[\s\x1c-\x1f\x85\xa0\p{Z}]+"
#: Lines that are folded at a time.
STRETCH = 256


def _bind(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def _opened(line: Column) -> Column:
    """What ends the comment, docstring or import that a line opens; null if it opens none."""
    starts = lambda words: F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.startswith(line, w))
    out = F.when(F.startswith(line, F.lit("/*")) & ~F.contains(F.substr(line, F.lit(3)), F.lit("*/")), F.lit("*/"))
    for q in QUOTES:
        alone = F.char_length(line) - F.char_length(F.replace(line, F.lit(q), F.lit(""))) == len(q)
        out = out.when(F.startswith(line, F.lit(q)), F.when(alone, F.lit(q)))
    for end, words in OPENS_GROUP.items():
        out = out.when(starts(words) & F.endswith(line, F.lit(end)), F.lit(CLOSES[end]))
    return out


def counted_lines(text: Column) -> Column:
    """(``n`` from 1, ``line``) of the lines that count for duplicates, white space
    collapsed. Blank lines, lines without a letter or digit, and lines that begin like a
    comment or an import do not count, nor do lines from one that opens a block comment,
    a docstring or a grouped import to the one that closes it.

    A fold over the lines, whose state is what would close the open block. It goes by
    stretches, so that a long text is not copied once a line. Null texts have no lines.
    """
    skip = lambda x: F.exists(F.array(*[F.lit(w) for w in SKIPPED]), lambda w: F.startswith(x, w))
    bare = F.transform(F.split(F.coalesce(text, F.lit("")), _ENDS), lambda x: F.trim(F.regexp_replace(x, _BLANKS, " ")))

    def judged(x: Column, i: Column) -> Column:
        opens = _opened(x)
        quoted = F.exists(F.array(*[F.lit(q) for q in QUOTES]), lambda q: F.startswith(x, q))
        counts = opens.isNull() & ~quoted & ~skip(x) & x.rlike(r"[\p{L}\p{N}]")
        return F.struct((i + 1).cast("int").alias("n"), x.alias("line"), opens.alias("opens"), counts.alias("counts"))

    none = F.lit(None).cast("string")
    start = lambda closer: F.struct(closer.alias("closer"), F.array().cast("array<boolean>").alias("kept"))

    def step(acc: Column, x: Column) -> Column:
        inside = acc.closer.isNotNull()
        closer = F.when(inside, F.when(F.contains(x.line, acc.closer), none).otherwise(acc.closer)).otherwise(x.opens)
        return F.struct(closer.alias("closer"), F.concat(acc.kept, F.array(x.counts & ~inside)).alias("kept"))

    def stretch(lines: Column):
        def fold(acc: Column, k: Column) -> Column:
            part = F.aggregate(F.slice(lines, k * STRETCH + 1, F.lit(STRETCH)), start(acc.closer), step)
            return F.struct(part.closer.alias("closer"), F.concat(acc.kept, part.kept).alias("kept"))

        return F.aggregate(F.sequence(F.lit(0), ((F.size(lines) - 1) / STRETCH).cast("int")), start(none), fold).kept

    kept = lambda lines: _bind(stretch(lines), lambda k: F.filter(lines, lambda x, i: F.get(k, i)))
    found = _bind(F.transform(bare, judged), kept)
    return F.transform(found, lambda x: F.struct(x.n.alias("n"), x.line.alias("line")))


def windows(texts: DataFrame, id_col: str, text: str, size: int = WINDOW) -> DataFrame:
    """Each run of ``size`` counted lines of each text: its place ``i`` among them, the
    first and the last line's number, and a hash. Nothing is shuffled."""
    digest = lambda x, i: F.md5(F.array_join(F.transform(F.slice(x, i + 1, F.lit(size)), lambda y: y.line), "\n").cast("binary"))
    one = lambda x, i: F.struct(i.alias("i"), F.element_at(x, i + 1).n.alias("n"), F.element_at(x, i + size).n.alias("last"), digest(x, i).alias("hash"))
    made = _bind(counted_lines(F.col(text)), lambda x: F.when(F.size(x) >= size, F.transform(F.sequence(F.lit(0), F.size(x) - size), lambda i: one(x, i))))
    return texts.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.inline(made))


def cover(stretches: list[tuple], size: int = WINDOW) -> list[tuple]:
    """The greedy cover of one component: (leader, place, length, places, stretch, start).

    ``stretches``: (id, start, rows, windows) by id and start, where windows are
    (offset, hash). The first of two rows stands for itself and the second, whose id is
    null, for all other rows of the same windows. From the first window on, one that no
    block covers leads a block: it and all equal windows, but for those of its own stretch
    less than ``size`` lines away, grow by lines as long as all go on alike.
    """
    where: dict[str, list[tuple[int, int]]] = {}
    at: list[dict[int, str]] = []
    for k, (_, _, _, found) in enumerate(stretches):
        at.append(dict(found))
        for offset, h in found:
            where.setdefault(h, []).append((k, offset))
    covered: list[set[int]] = [set() for _ in stretches]
    out = []
    for k, (id_, start, _, found) in enumerate(stretches):
        if id_ is None:
            continue
        for offset, h in found:
            if offset in covered[k]:
                continue
            places = [(s, o) for s, o in where[h] if s != k or o == offset or abs(o - offset) >= size]
            rows = sum(stretches[s][2] for s, _ in places)
            if rows < 2:
                continue
            grown = 1
            while (after := at[k].get(offset + grown)) is not None and all(at[s].get(o + grown) == after for s, o in places):
                grown += 1
            length = size + grown - 1
            for s, o in places:
                covered[s].update(range(o, o + length))
                out.append((id_, start + offset, length, rows, s, o))
    return out


def blocks(texts: DataFrame, id_col: str, text: str, size: int = WINDOW) -> DataFrame:
    """Repeated blocks, a row a place: ``leader`` and ``leader_i`` (the text that a block
    was found in and its place among the counted lines there), ``length`` in counted lines,
    ``places``, and of this place ``id``, ``start_line`` and ``end_line``.

    Texts are gone through by id and place. A window of ``size`` lines that no block covers
    yet and that stands elsewhere too (in its own text ``size`` lines away or more) begins
    a block of all its places, which grows line by line while all places go on alike, and
    then covers them.

    Windows are hashed in their rows and counted by hash; only repeated ones go on. Those
    less than ``size`` lines apart make a stretch. Stretches of equal windows fare alike, but
    for the first one, which may lead: two rows stand for all copies, however many. What
    shares a window is a component, and each is covered by a task of its own, which so holds
    different contents only. Texts without an id are left out, empty and null ones have no
    lines, ids are taken to be unique. An empty table gives an empty result.
    """
    found = stage(windows(texts, id_col, text, size), "windows")
    twice = found.groupBy("hash").agg(F.count("*").alias("times")).filter("times > 1").select(F.col("hash").alias("h"))
    kept = found.join(twice, F.col("hash") == F.col("h"), "left_semi")
    by_place = Window.partitionBy("id").orderBy("i")
    apart = F.coalesce((F.col("i") - F.lag("i").over(by_place) >= size).cast("int"), F.lit(1))
    numbered = kept.withColumn("apart", apart).withColumn("nth", F.sum("apart").over(by_place))
    first = F.min("i").over(Window.partitionBy("id", "nth"))
    placed = stage(numbered.select("id", first.alias("start"), (F.col("i") - first).alias("offset"), "n", "last", "hash"), "repeated")
    # What a stretch holds, as one key: sorted offsets with their hashes.
    held = F.array_sort(F.collect_list(F.struct("offset", "hash")))
    stretches = stage(placed.groupBy("id", "start").agg(held.alias("held")).withColumn("content", F.sha2(F.to_json("held"), 256)), "stretches")
    heads = stretches.groupBy("content").agg(F.min(F.struct("id", "start")).alias("head"), F.count("*").alias("rows"))
    heads = heads.select(F.col("content").alias("c"), F.col("head.id").alias("h_id"), F.col("head.start").alias("h_start"), "rows")
    same = (F.col("content") == F.col("c")) & (F.col("id") == F.col("h_id")) & (F.col("start") == F.col("h_start"))
    classes = stage(stretches.join(heads, same).select("content", "id", "start", "rows", "held"), "classes")
    # Classes that share a window: each window's classes meet its least one.
    by_hash = classes.select("content", F.explode("held.hash").alias("hash")).distinct()
    least = by_hash.groupBy("hash").agg(F.min("content").alias("least")).withColumnRenamed("hash", "of")
    links = by_hash.join(least, F.col("hash") == F.col("of")).filter("content <> least").select(F.col("content").alias("src"), F.col("least").alias("dst"))
    groups = connected(links).withColumnRenamed("id", "member")
    grouped = classes.join(groups, F.col("content") == F.col("member"), "left").select(F.coalesce("component", "content").alias("component"), "content", "id", "start", "rows", "held")

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["id", "start"]).reset_index(drop=True)
        rows, names = [], []
        for r in part.itertuples(index=False):
            held = [(w["offset"], w["hash"]) for w in r.held]
            rows.append((r.id, r.start, 1, held))
            names.append((r.content, True))
            if r.rows > 1:
                rows.append((None, None, r.rows - 1, held))
                names.append((r.content, False))
        made = [(a, i, n, p, *names[s], o) for a, i, n, p, s, o in cover(rows, size)]
        return pd.DataFrame(made, columns=["leader", "leader_i", "length", "places", "content", "head", "offset"])

    kind = classes.schema["id"].dataType.simpleString()
    schema = f"leader {kind}, leader_i int, length int, places long, content string, head boolean, offset int"
    covered = grouped.groupBy("component").applyInPandas(run, schema).withColumnRenamed("content", "of")
    members = stretches.select("content", "id", "start").join(heads.select("c", "h_id", "h_start"), F.col("content") == F.col("c"))
    members = members.select("content", "id", "start", ((F.col("id") == F.col("h_id")) & (F.col("start") == F.col("h_start"))).alias("is_head"))
    spread = covered.join(members, (F.col("of") == F.col("content")) & (F.col("head") == F.col("is_head")))
    spread = spread.select("leader", "leader_i", "length", "places", "id", "start", "offset", (F.col("offset") + F.col("length") - size).alias("end"))
    a = placed.select(F.col("id").alias("a_id"), F.col("start").alias("a_start"), F.col("offset").alias("a_offset"), F.col("n").alias("start_line"))
    b = placed.select(F.col("id").alias("b_id"), F.col("start").alias("b_start"), F.col("offset").alias("b_offset"), F.col("last").alias("end_line"))
    out = spread.join(a, (F.col("id") == F.col("a_id")) & (F.col("start") == F.col("a_start")) & (F.col("offset") == F.col("a_offset")))
    out = out.join(b, (F.col("id") == F.col("b_id")) & (F.col("start") == F.col("b_start")) & (F.col("end") == F.col("b_offset")))
    return out.select("leader", "leader_i", "length", "places", "id", "start_line", "end_line")


def violations(found: DataFrame) -> DataFrame:
    """The check of repeated blocks (check, file, line, value): one a block, at its least
    place, for ``health.assess``."""
    place = F.min(F.struct("id", "start_line")).alias("p")
    one = found.groupBy("leader", "leader_i", "length").agg(place)
    return one.select(F.lit("duplicated-block").alias("check"), F.col("p.id").alias("file"), F.col("p.start_line").alias("line"), F.col("length").cast("long").alias("value"))
