"""A quality classifier of few rules: paths of trees, weighed by a sparse logistic fit."""

from __future__ import annotations

import math
import warnings
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evgraph.llm import quality
from evgraph.llm.common import quoted, stage, without, words_of

#: The statistics of a text, in the order of ``statistics``.
STATISTICS = (
    "word_chars", "symbols", "marks", "stop_words", "line_words", "dup_lines", "repeat_words",
    "variety", "capitals", "digits", "stops", "commas", "bars",
)


def statistics(text: Column) -> Column:
    """The statistics of a whole text as a struct of doubles, by native functions: shares
    of its words, of its lines (``dup_lines``) or of its characters (``capitals``,
    ``digits``), and logarithms (``line_words``; ``variety``, that of the distinct words
    over that of all). None says how long a text is, and none drifts much with length,
    so that texts longer than all labelled ones are judged alike. A null text is empty,
    and an empty one has 0 everywhere."""
    text = F.coalesce(text, F.lit(""))
    n = lambda pattern: F.regexp_count(text, F.lit(pattern)).cast("double")

    def of(m: Column) -> Column:
        words, lines = F.greatest(m.q.w.n_words, F.lit(1)), F.greatest(m.q.l.n_lines, F.lit(1))
        chars = F.greatest(m.chars, F.lit(1))
        values = {
            "word_chars": m.q.w.word_chars / words,
            "symbols": m.q.n_symbols / words,
            "marks": m.q.n_marks / words,
            "stop_words": m.q.w.n_stop_words / words,
            "line_words": F.log1p(m.q.w.n_words / lines),
            "dup_lines": m.q.l.n_dup_lines / lines,
            "repeat_words": m.q.w.n_repeat_words / words,
            "variety": F.log1p(m.distinct.cast("double")) / F.log1p(words.cast("double")),
            "capitals": m.capitals / chars,
            "digits": m.digits / chars,
            "stops": m.stops / words,
            "commas": m.commas / words,
            "bars": m.bars / words,
        }
        return F.struct(*[values[k].cast("double").alias(k) for k in STATISTICS])

    counts = F.struct(
        quality.metrics(text).alias("q"), F.char_length(text).alias("chars"), F.size(F.array_distinct(words_of(text))).alias("distinct"),
        n(r"\p{Lu}").alias("capitals"), n(r"\d").alias("digits"), n(r"[.?]").alias("stops"), n(",").alias("commas"), n(r"\|").alias("bars"),
    )
    return F.element_at(F.transform(F.array(counts), of), 1)


#: Of one statistic: its name, the value that it is above and the one it is at most.
Condition = tuple[str, float, float]


@dataclass(frozen=True)
class Rule:
    """Holds where all its conditions do; then it adds ``weight`` to the log odds."""

    conditions: tuple[Condition, ...]
    weight: float = 0.0

    def holds(self, rows: np.ndarray) -> np.ndarray:
        out = np.ones(len(rows), dtype=bool)
        for name, above, most in self.conditions:
            x = rows[:, STATISTICS.index(name)]
            out &= (x > above) & (x <= most)
        return out

    def column(self, s: Column) -> Column:
        held = F.lit(True)
        for name, above, most in self.conditions:
            if above > -math.inf:
                held = held & (s[name] > F.lit(above))
            if most < math.inf:
                held = held & (s[name] <= F.lit(most))
        return F.when(held, F.lit(self.weight)).otherwise(F.lit(0.0))

    def __str__(self) -> str:
        told = [f"{above:.4g} < {name} <= {most:.4g}" for name, above, most in self.conditions]
        return f"{self.weight:+.3f} if " + " and ".join(told)


@dataclass(frozen=True)
class Model:
    """Log odds of a good text: ``base`` and the weights of all rules that hold."""

    base: float
    rules: tuple[Rule, ...] = field(default=())

    def probability(self, s: Column) -> Column:
        """The model as one expression over a struct of ``statistics``."""
        odds = F.lit(self.base)
        for rule in self.rules:
            odds = odds + rule.column(s)
        return 1 / (1 + F.exp(-odds))

    def predict(self, rows: np.ndarray) -> np.ndarray:
        odds = self.base + sum((r.weight * r.holds(rows) for r in self.rules), np.zeros(len(rows)))
        return 1 / (1 + np.exp(-odds))


def _cuts(x: np.ndarray, most: int) -> np.ndarray:
    """Values half way between neighbours at quantiles."""
    u = np.unique(x)
    if len(u) > most:
        u = np.unique(np.quantile(x, np.linspace(0, 1, most), method="nearest"))
    return (u[1:] + u[:-1]) / 2


def grow(rows: np.ndarray, slope: np.ndarray, bend: np.ndarray, columns: list[int], depth: int, least: int, bins: int = 48):
    """A regression tree of Newton steps, by the gain in squared slope over curvature.
    Yields the conditions of every node but the root, and the step of every leaf."""

    def split(at: np.ndarray, path: dict[int, tuple[float, float]], level: int):
        g, h = slope[at].sum(), bend[at].sum() + 1.0
        best = None
        if level < depth and len(at) >= 2 * least:
            for c in columns:
                x = rows[at, c]
                cuts = _cuts(x, bins)
                if not len(cuts):
                    continue
                bin_of = np.searchsorted(cuts, x, side="left")
                n = np.cumsum(np.bincount(bin_of, minlength=len(cuts) + 1))[:-1]
                gl = np.cumsum(np.bincount(bin_of, weights=slope[at], minlength=len(cuts) + 1))[:-1]
                hl = np.cumsum(np.bincount(bin_of, weights=bend[at], minlength=len(cuts) + 1))[:-1]
                gain = gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl) - g**2 / h
                gain[(n < least) | (len(at) - n < least)] = -1
                k = int(np.argmax(gain))
                if gain[k] > 1e-6 and (best is None or gain[k] > best[0] + 1e-12):
                    best = (float(gain[k]), c, float(cuts[k]))
        if level:
            yield path, at, (g / h if best is None else None)
        elif best is None:
            yield None, at, g / h
        if best is not None:
            _, c, cut = best
            above, most = path.get(c, (-math.inf, math.inf))
            low = rows[at, c] <= cut
            yield from split(at[low], path | {c: (above, min(most, cut))}, level + 1)
            yield from split(at[~low], path | {c: (max(above, cut), most)}, level + 1)

    yield from split(np.arange(len(rows)), {}, 0)


def rules_of(rows: np.ndarray, good: np.ndarray, trees: int, depth: int, least: int, seed: int = 5) -> list[Rule]:
    """The paths of boosted trees as rules, each grown on half of the rows and columns.
    Of rules that hold for the same rows the first is kept."""
    rng = np.random.default_rng(seed)
    share = np.clip(good.mean(), 1e-3, 1 - 1e-3)
    odds = np.full(len(rows), math.log(share / (1 - share)))
    out: list[Rule] = []
    held: set[bytes] = set()
    for _ in range(trees):
        at = rng.permutation(len(rows))[: max(1, len(rows) // 2)]
        columns = sorted(rng.permutation(rows.shape[1])[: max(1, rows.shape[1] // 2)].tolist())
        p = 1 / (1 + np.exp(-odds))
        for path, _, step in grow(rows[at], (good - p)[at], (p * (1 - p))[at], columns, depth, least):
            if path is None:
                continue
            rule = Rule(tuple((STATISTICS[c], *path[c]) for c in sorted(path)))
            holds = rule.holds(rows)
            if step is not None:
                odds = odds + 0.3 * step * holds
            key = np.packbits(holds).tobytes()
            if key not in held and np.packbits(~holds).tobytes() not in held:
                held.add(key)
                out.append(rule)
    return out


def lasso(x: np.ndarray, good: np.ndarray, penalty: float, steps: int = 800) -> tuple[float, np.ndarray]:
    """Logistic weights of 0/1 columns under an L1 penalty, by proximal gradient steps with
    momentum. Columns are scaled by their deviation, so rare rules pay no less."""
    mean, n = x.mean(axis=0), len(x)
    scale = np.maximum(x.std(axis=0), 1e-3)
    z = (x - mean) / scale
    rate = 4 / max(1e-9, float(np.linalg.norm(z, 2) ** 2 / n))
    share = np.clip(good.mean(), 1e-3, 1 - 1e-3)
    w, base, t = np.zeros(x.shape[1]), math.log(share / (1 - share)), 1.0
    ahead, ahead_base = w, base
    for _ in range(steps):
        gap = 1 / (1 + np.exp(-np.clip(z @ ahead + ahead_base, -40, 40))) - good
        step = ahead - rate * (z.T @ gap) / n
        step = np.sign(step) * np.maximum(np.abs(step) - rate * penalty, 0)
        step_base = ahead_base - min(rate, 4.0) * gap.mean()
        after = (1 + math.sqrt(1 + 4 * t * t)) / 2
        ahead, ahead_base = step + (t - 1) / after * (step - w), step_base + (t - 1) / after * (step_base - base)
        w, base, t = step, step_base, after
    return base - float((w / scale) @ mean), w / scale


def fit(rows: np.ndarray, good: np.ndarray, fold: np.ndarray, trees: int = 40, depth: int = 3) -> Model:
    """Rules from trees, then the penalty that predicts the rows of ``fold`` best when fitted
    to the others, then weights fitted to all rows under it."""
    share = float(np.clip(good.mean(), 1e-3, 1 - 1e-3)) if len(good) else 0.5
    base = Model(math.log(share / (1 - share)))
    if not len(good) or good.min() == good.max():
        return base
    found = rules_of(rows, good, trees, depth, least=max(3, len(rows) // 100))
    if not found:
        return base
    x = np.stack([r.holds(rows) for r in found], axis=1).astype(float)
    penalty, noise = None, math.sqrt(math.log(len(found) + 2) / len(rows))
    if 0 < fold.sum() < len(fold) and good[~fold].min() < good[~fold].max():
        losses = []
        for factor in (1.0, 0.5, 0.25, 0.12, 0.06, 0.03):
            b, w = lasso(x[~fold], good[~fold], factor * noise, steps=300)
            p = np.clip(1 / (1 + np.exp(-(b + x[fold] @ w))), 1e-6, 1 - 1e-6)
            losses.append((-float(np.mean(good[fold] * np.log(p) + (1 - good[fold]) * np.log(1 - p))), factor))
        least = min(losses)[0]
        # The sparsest one that is as good as any, but for a tenth.
        penalty = max(f for loss, f in losses if loss <= 1.1 * least + 1e-4) * noise
    b, w = lasso(x, good, penalty or 0.25 * noise)
    kept = [Rule(r.conditions, float(k)) for r, k in zip(found, w.tolist(), strict=True) if abs(k) > 1e-6]
    return Model(b, tuple(sorted(kept, key=lambda r: -abs(r.weight))))


def held_out(doc_id: Column) -> Column:
    """Documents whose labels may not be learned; a null id has no label."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "quality",
    sample_rows: int = 8000, trees: int = 40, depth: int = 3,
) -> Model:
    """Fit to at most ``sample_rows`` labelled documents that are not held out, those of the
    least hash of their ids, so reruns agree. Spark makes their statistics; only these, 13
    numbers a row, reach the driver.

    An id labelled twice is good if all its labels say so, one with several texts takes the
    least; null ids, labels and texts are left out. Without labels of both kinds all texts
    get the share of good ones (one half without any), with a warning.
    """
    y = F.min((quoted(label) > 0).cast("int")).alias("y")
    known = labels.filter(quoted(label).isNotNull() & quoted(id_col).isNotNull() & ~held_out(quoted(id_col))).groupBy(quoted(id_col).alias("k")).agg(y)
    texts = docs.select(quoted(id_col).alias("d"), quoted(text).alias("x")).filter("x is not null")
    present = known.join(texts.select("d"), F.col("k") == F.col("d"), "left_semi")
    chosen = present.orderBy(F.xxhash64("k"), "k").limit(sample_rows)
    rows = texts.join(F.broadcast(chosen), F.col("d") == F.col("k")).groupBy("k", "y").agg(F.min("x").alias("x"))
    fold = (F.pmod(F.xxhash64("k", F.lit(1)), F.lit(4)) == 0).alias("fold")
    got = stage(rows.select(F.xxhash64("k").alias("h"), "k", "y", fold, statistics(F.col("x")).alias("s")), "statistics").orderBy("h", "k").toPandas()
    found = np.array([[r[k] for k in STATISTICS] for r in got["s"]], dtype=float).reshape(-1, len(STATISTICS))
    good = got["y"].to_numpy(dtype=float)
    if not len(good) or good.min() == good.max():
        warnings.warn("no labels of both kinds: all texts score alike", stacklevel=2)
    return fit(found, good, got["fold"].to_numpy(dtype=bool), trees, depth)


def score(docs: DataFrame, model: Model, text: str = "text", least: float = 0.7) -> DataFrame:
    """Add ``score``, the probability of a good text, and ``predicted`` (1 from ``least``).

    One narrow projection without user functions: no shuffle, any row count; the rules are
    part of the expression. Null and empty texts have statistics of 0 and score like any
    other; texts of any length are read whole, repeated rows score alike. Columns named
    like an added one, in any case, are replaced; others pass through. An empty table
    gives an empty result.
    """
    if text.lower() in ("score", "predicted"):
        raise ValueError(f"the text column may not be named {text}")

    def of(s: Column) -> Column:
        p = model.probability(s)
        return F.struct(p.alias("score"), (p >= F.lit(least)).cast("int").alias("predicted"))

    return without(docs, "score", "predicted").select("*", F.inline(F.transform(F.array(statistics(quoted(text))), of)))
