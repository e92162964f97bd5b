"""Best-fit packing of tokenised documents: bin completion over length counts."""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evgraph.llm.common import quoted, stage, without
from evgraph.llm.tokens import default_path, encoder

#: One kind of sequence: lengths with how often each occurs in it, longest first.
Pattern = tuple[tuple[int, int], ...]


def _pattern(lengths: list[int]) -> Pattern:
    count: dict[int, int] = defaultdict(int)
    for x in lengths:
        count[x] += 1
    return tuple(sorted(count.items(), reverse=True))


def lower_bound(counts: dict[int, int], size: int) -> int:
    """Bins that any packing needs: the best of the fill bound and, for every
    threshold k, items over size - k alone plus the fill of those from k up."""
    n = np.zeros(size + 1, dtype=np.int64)
    for x, c in counts.items():
        n[x] = c
    return _bound(n, size)


def _bound(n: np.ndarray, size: int) -> int:
    """``lower_bound`` of counts by length, in one pass over the lengths."""
    x, half = np.arange(size + 1), size // 2
    fill = n * x
    # Items over half the size take a bin each, whatever the threshold is.
    large = int(n[half + 1 :].sum())
    small = np.cumsum(fill[half::-1])[::-1]
    room = np.concatenate([[0], np.cumsum((n * (size - x))[half + 1 :])])
    over = int((small - room[size - x[: half + 1] - half]).max())
    return max(-(-int(fill.sum()) // size), large + max(0, -(-over // size)))


def best_fit(counts: dict[int, int], size: int) -> dict[Pattern, int]:
    """Best-fit decreasing on counts: each step places all that it can at once, so
    the steps depend on the number of lengths and not on that of documents."""
    open_bins: dict[int, dict[tuple, int]] = defaultdict(lambda: defaultdict(int))
    done: dict[tuple, int] = defaultdict(int)

    def put(lengths: tuple, room: int, n: int) -> None:
        if room:
            open_bins[room][lengths] += n
        else:
            done[lengths] += n

    for x in sorted(counts, reverse=True):
        left = counts[x]
        rooms = [r for r in open_bins if r >= x]
        while left and rooms:
            room = min(rooms)
            group = open_bins[room]
            while left and group:
                lengths, n = next(iter(group.items()))
                used = min(n, left)
                group[lengths] -= used
                if not group[lengths]:
                    del group[lengths]
                left -= used
                put((*lengths, x), room - x, used)
            if not group:
                del open_bins[room]
            rooms = [r for r in open_bins if r >= x]
        per = size // x
        if left >= per:
            put((x,) * per, size - x * per, left // per)
        if left % per:
            put((x,) * (left % per), size - x * (left % per), 1)
    for room in open_bins.values():
        for lengths, n in room.items():
            done[lengths] += n
    out: dict[Pattern, int] = defaultdict(int)
    for lengths, n in done.items():
        out[_pattern(list(lengths))] += n
    return dict(out)


def _spread(bits: int, most: int) -> int:
    """``bits`` shifted by 0 to ``most`` places, all joined."""
    done = 0
    while done < most:
        step = min(done + 1, most - done)
        bits |= bits << step
        done += step
    return bits


class Fillings:
    """Undominated fillings of a bin, one at a time, fullest first.

    Sets of lengths and of sums are the bits of whole numbers, so a step costs the
    same for five lengths and for 2048. ``seen`` counts partial fillings.
    """

    def __init__(self):
        self.seen = 0

    def after(self, counts: list[int], room: int, most: int, last: tuple[int, ...] | None, stop: int) -> tuple[int, ...] | None:
        """The first filling of ``room`` that follows ``last`` in the order by sum,
        then by lengths (both from the largest), and wastes ``most`` or less. None
        if there is none, or when ``seen`` comes to ``stop``.

        A filling is left out if an unused piece fits into it, alone or for a group
        of its pieces that is no longer than it: with the two swapped, any packing
        stays one.
        """
        reach, sums, lengths, full = {}, 1, 0, (1 << room + 1) - 1
        for x in range(1, room + 1):
            if n := min(counts[x], room // x):
                k = 1
                while n:
                    k = min(k, n)
                    sums |= sums << k * x & full
                    n, k = n - k, 2 * k
                reach[x], lengths = sums, lengths | 1 << x
        back = int(format(sums, f"0{room + 1}b")[::-1], 2)  # bit room - s for every sum s
        first = room - sum(last) if last is not None else 0
        for waste in range(first, min(most, room) + 1):
            if sums >> room - waste & 1:
                got = self._filled(counts, reach, lengths, back, room, waste, last if waste == first else None, stop)
                if got is not None or self.seen >= stop:
                    return got
        return None

    def _filled(self, counts, reach, lengths, back, room, waste, last, stop) -> tuple[int, ...] | None:
        def choices(left: int, top: int, free: int) -> int:
            return free & back >> room - left & (1 << min(left, top) + 1) - 1

        # A level: what is left, next pieces to try, unused lengths, single pieces,
        # sums of two pieces and more, how often the last occurs, if like ``last``.
        goal = room - waste
        top = last[0] if last else room
        fill: list[int] = []
        levels = [[goal, choices(goal, top, lengths), lengths, 0, 0, 0, last is not None]]
        if not goal:
            free = lengths & (1 << waste + 1) - 1
            return None if last is not None or free else ()
        while levels:
            left, todo, free, one, more, n, like = level = levels[-1]
            if not todo:
                levels.pop()
                if fill:
                    fill.pop()
                continue
            x = todo.bit_length() - 1
            level[1] = todo ^ 1 << x
            if not reach[x] >> left - x & 1:
                continue
            self.seen += 1
            if self.seen >= stop:
                return None
            times = n + 1 if fill and fill[-1] == x else 1
            more |= more << x | one << x
            one |= 1 << x
            if times == counts[x]:
                free ^= 1 << x
            # Pieces longer than x are settled, so this holds for all that follows.
            if free & (_spread(more, waste) | (_spread(one << 1, waste - 1) if waste else 0)):
                continue
            like = like and x == last[len(fill)]
            if left == x:
                if not like and not free & (1 << waste + 1) - 1:
                    return (*fill, x)
                continue
            top = min(x, last[len(fill) + 1]) if like else x
            fill.append(x)
            levels.append([left - x, choices(left - x, top, free), free, one, more, times, like])
        return None


def _likely(rest: dict[int, int], room: int, keep: int = 6) -> list[list[int]]:
    """A few full fillings by one or two pieces beside a chain of large ones: each
    pair search is one sorted lookup of all lengths."""
    up = np.array(sorted(x for x, c in rest.items() if c and x <= room), dtype=np.int64)
    found: list[list[int]] = []
    chain: list[int] = []
    while True:
        room_left = room - sum(chain)
        fits = up[up <= room_left]
        if not len(fits):
            found.append(list(chain))
            break
        gap = room_left - fits
        at = np.searchsorted(fits, gap, side="right") - 1
        lost = np.where(at >= 0, gap - fits[np.maximum(at, 0)], gap)
        for i in np.lexsort((-fits, lost))[:keep].tolist():
            pair = [int(fits[i]), int(fits[at[i]])] if at[i] >= 0 else [int(fits[i])]
            found.append(sorted([*chain, *pair], reverse=True))
        chain.append(int(fits[-1]))
    found = [f for f in found if all(f.count(x) <= rest[x] for x in set(f))]
    return sorted(found, key=lambda f: (sum(f), f), reverse=True)[:keep] or [[]]


def _first_packing(counts: dict[int, int], size: int, nodes: int) -> dict[Pattern, int]:
    """A packing for the search to start from: best-fit decreasing, improved by a
    quick search over the few fillings that ``_likely`` gives."""
    best = best_fit(counts, size)
    used, bound = sum(best.values()), lower_bound(counts, size)
    total = sum(x * c for x, c in counts.items())
    rest, path, bins, waste, spent = dict(counts), [], 0, 0, 0
    # What is still to try after each step of the path, so memory grows with the path alone.
    levels: list[list[tuple[Pattern, int, int]]] = [[((), 0, 0)]]

    def put(pattern: Pattern, times: int) -> None:
        for x, n in pattern:
            left = rest.get(x, 0) - n * times
            if left:
                rest[x] = left
            else:
                del rest[x]

    while levels and used > bound and spent < nodes:
        if not levels[-1]:
            levels.pop()
            if path:
                pattern, times, lost = path.pop()
                put(pattern, -times)
                bins, waste = bins - times, waste - lost * times
            continue
        pattern, times, lost = levels[-1].pop()
        put(pattern, times)
        path.append((pattern, times, lost))
        bins, waste = bins + times, waste + lost * times
        nexts: list[tuple[Pattern, int, int]] = []
        levels.append(nexts)
        if not rest:
            if bins < used:
                used, best = bins, _summed([step for step in path if step[1]])
            continue
        allowed = (used - 1) * size - total
        if waste > allowed:
            continue
        spent += 1
        x = max(rest)
        for fill in _likely({**rest, x: rest[x] - 1}, size - x):
            pattern = _pattern([x, *fill])
            times = min(rest[k] // n for k, n in pattern)
            lost = size - sum(k * n for k, n in pattern)
            if lost:
                times = max(1, min(times, (allowed - waste) // lost))
            if waste + lost * times <= allowed:
                nexts.append((pattern, times, lost))
        nexts.reverse()
    return dict(best)


def bin_completion(counts: dict[int, int], size: int, nodes: int = 10_000, width: int = 100) -> dict[Pattern, int]:
    """Fewest sequences of ``size`` for the counted lengths: pattern -> how many.

    Branch and bound, the same at every number of lengths: take the largest length
    left, branch over its undominated fillings (found one by one, fullest first) and
    over how often each is applied, the most first, and prune where the waste so far
    exceeds what a packing better than the incumbent may waste, or where the lower
    bound of what is left rules one out. Bins of one length are taken in the order
    of their fillings, so no mix of fillings is missed or tried twice.

    The incumbent starts as best-fit decreasing, improved by a quick search of
    ``nodes`` steps at most (see ``_first_packing``). The search ends when it meets the
    lower bound, when nothing is left to try (it is then the optimum), or after
    ``nodes`` branchings or ``nodes * width`` partial fillings in all, whatever the
    counts are.
    """
    counts = {x: c for x, c in counts.items() if c}
    if any(x > size or x < 1 for x in counts):
        raise ValueError("a length is out of range")
    if not counts:
        return {}
    best = _first_packing(counts, size, nodes)
    used, bound = sum(best.values()), lower_bound(counts, size)
    total = sum(x * c for x, c in counts.items())
    rest = [counts.get(x, 0) for x in range(size + 1)]
    fillings, stop, spent, bins, waste = Fillings(), nodes * width, 0, 0, 0
    path: list[tuple[Pattern, int, tuple[int, ...]]] = []

    def put(pattern: Pattern, times: int) -> None:
        nonlocal bins, waste
        for x, n in pattern:
            rest[x] -= n * times
        bins += times
        waste += times * (size - sum(x * n for x, n in pattern))

    def back() -> tuple[int, tuple[int, ...]]:
        """Applies the last filling once less; its largest length, and itself."""
        pattern, times, fill = path.pop()
        put(pattern, -1)
        if times > 1:
            path.append((pattern, times - 1, fill))
        return pattern[0][0], fill

    top, last = size, None
    while used > bound and spent < nodes and fillings.seen < stop:
        while top and not rest[top]:
            top, last = top - 1, None
        if not top and bins < used:
            used, best = bins, _summed(path)
        allowed = (used - 1) * size - total - waste
        fill = None
        if top and allowed >= 0 and bins + _bound(np.array(rest), size) < used:
            rest[top] -= 1
            fill = fillings.after(rest, size - top, allowed, last, stop)
            rest[top] += 1
        if fill is None:
            if not path or fillings.seen >= stop:
                break
            top, last = back()
            continue
        spent += 1
        pattern = _pattern([top, *fill])
        times, lost = min(rest[x] // n for x, n in pattern), size - top - sum(fill)
        if lost:
            times = min(times, allowed // lost)
        put(pattern, times)
        path.append((pattern, times, fill))
        last = fill
    return best


def _summed(path: list[tuple[Pattern, int, tuple[int, ...]]]) -> dict[Pattern, int]:
    """How often each pattern occurs on a path of the search."""
    out: dict[Pattern, int] = defaultdict(int)
    for pattern, n, _ in path:
        out[pattern] += n
    return dict(out)


def slots(packing: dict[Pattern, int]) -> tuple[np.ndarray, ...]:
    """Where the r-th piece of a length goes, as sorted arrays: length, first r,
    first sequence, pieces of that length in a sequence, offset of the first."""
    rows, base, seen = [], 0, defaultdict(int)
    for pattern, n in sorted(packing.items(), reverse=True):
        offset = 0
        for x, k in pattern:
            rows.append((x, seen[x], base, k, offset))
            seen[x] += k * n
            offset += x * k
        base += n
    rows.sort()
    return tuple(np.array(c, dtype=np.int64) for c in zip(*rows, strict=True)) if rows else (np.zeros(0, np.int64),) * 5


def pieces(docs: DataFrame, id_col: str, text: str, size: int, end: int, path: str | None, with_ids: bool) -> DataFrame:
    """One row per piece: the ids of a whole text and ``end``, cut only if longer
    than ``size``, into full pieces after a first one that takes the remainder.

    ``__evgraph_block`` and ``__evgraph_nth`` number the pieces of a length within
    the task that made them; they hold once staged.
    """
    file = path or default_path()
    kind = docs.select(quoted(id_col)).schema[0].dataType.simpleString()
    schema = f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long, __evgraph_block int, __evgraph_nth long"
    schema += ", ids array<int>" if with_ids else ""

    def cut(batches):
        e, nth = encoder(file), np.zeros(size + 1, dtype=np.int64)
        block = TaskContext.get().partitionId()
        for batch in batches:
            out = []
            for key, t in zip(batch["k"], batch["t"], strict=True):
                ids = np.append(e.ids(t or ""), np.uint32(end)).astype("<u4")
                first = len(ids) % size or size
                edges = [0, *range(first, len(ids) + 1, size)]
                for i in range(len(edges) - 1):
                    part = ids[edges[i] : edges[i + 1]]
                    row = (key, i, edges[i], len(part), zlib.crc32(part.tobytes()), block, int(nth[len(part)]))
                    nth[len(part)] += 1
                    out.append((*row, part.astype(np.int32)) if with_ids else row)
            names = [id_col, "piece", "start", "length", "ids_crc32", "__evgraph_block", "__evgraph_nth"]
            frame = pd.DataFrame(out, columns=[*names, "ids"] if with_ids else names)
            frame[id_col] = frame[id_col].astype(object if batch["k"].dtype == object else batch["k"].dtype)
            yield frame

    chosen = docs.select(quoted(id_col).alias("k"), quoted(text).alias("t"))
    if kind in ("bigint", "int", "smallint", "tinyint"):
        # Nullable integers would reach pandas as floats.
        chosen = chosen.withColumn("k", F.col("k").cast("string"))
        made = chosen.mapInPandas(cut, schema.replace(f"`{id_col}` {kind}", f"`{id_col}` string"))
        return made.withColumn(id_col, quoted(id_col).cast(kind))
    return chosen.mapInPandas(cut, schema)


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    size: int = 2048,
    end: int = 0,
    path: str | None = None,
    with_ids: bool = True,
    nodes: int = 10_000,
) -> DataFrame:
    """Every piece of every document with its ``sequence_id`` and ``offset``.

    Only lengths matter to the packing, so it is solved once over the counts of the
    at most ``size`` lengths, however many documents there are: that table is all
    the driver gets, and all that tasks get back is the list of patterns. A piece
    then finds its place from its number among the pieces of its length, by binary
    search. Those numbers come from the tasks that cut the texts (counted per task,
    staged, then offset by a running sum over tasks), so a length that a third of
    all pieces share is never gathered anywhere.

    Null text counts as empty (one piece, ``end`` alone); null ids stay null; every
    repeated row is packed; texts are encoded whole; columns of the input but the
    id are left out; an empty table gives an empty result. Integer ids keep type.
    """
    staged = stage(pieces(docs, id_col, text, size, end, path, with_ids), "pieces")
    block, nth = F.col("__evgraph_block"), F.col("__evgraph_nth")
    per_block = staged.groupBy("__evgraph_block", "length").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in per_block.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    lengths, first, base, per, offset = slots(bin_completion(counts, size, nodes))
    before = Window.partitionBy("length").orderBy("__evgraph_block").rowsBetween(Window.unboundedPreceding, -1)
    bases = per_block.select(
        F.col("__evgraph_block").alias("b"), F.col("length").alias("x"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")
    )
    key = lengths * (1 << 42) + first if len(lengths) else lengths

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, r: pd.Series) -> pd.DataFrame:
        length, r = length.to_numpy(), r.to_numpy()
        at = np.searchsorted(key, length * (1 << 42) + r, side="right") - 1
        nth_of = r - first[at]
        return pd.DataFrame({"sequence_id": base[at] + nth_of // per[at], "offset": offset[at] + nth_of % per[at] * length})

    numbered = staged.join(bases, (block == F.col("b")) & (F.col("length") == F.col("x"))).withColumn("__evgraph_r", nth + F.col("base"))
    placed = numbered.withColumn("__evgraph_at", place("length", "__evgraph_r"))
    kept = [quoted(c) for c in without(staged, "__evgraph_block", "__evgraph_nth").columns]
    return placed.select(*kept, "__evgraph_at.sequence_id", "__evgraph_at.offset")


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves: ``sequence_id`` and its ids in order. A
    sequence holds at most as many pieces as tokens, so its group is bounded. Empty and
    null texts are there by their end alone; an empty table gives none; pieces must
    have been packed ``with_ids``, other columns are left out."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p.ids)).alias("ids"))
