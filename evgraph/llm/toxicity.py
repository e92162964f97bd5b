"""Toxicity grades by cumulative-link ordinal regression on sparse word features."""

from __future__ import annotations

import math
import re
import warnings
import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evgraph.llm.common import quoted, stage, without

_TOKEN = re.compile(r"\w+")
#: Lengths of the word stems that count as features beside whole words.
STEMS = range(4, 9)
#: Words of the stretches of a text that are scored one by one.
WINDOW = 200


def words_of(text: str | None) -> list[str]:
    """Lower-case words of a whole text, in order."""
    return _TOKEN.findall((text or "").lower())


def features_of(words: dict[str, int]) -> dict[str, int]:
    """Counts of words and of their stems, written ``stem*``."""
    out = dict(words)
    for w, n in words.items():
        for k in STEMS:
            if len(w) <= k:
                break
            stem = w[:k] + "*"
            out[stem] = out.get(stem, 0) + n
    return out


def weighed(count: int, total: int) -> float:
    """How much of a feature a text has: logarithm of one plus its count in 200 words."""
    return math.log1p(200 * count / total)


@dataclass
class Model:
    """P(grade >= k) = sigmoid(w . x - cut_k) with one w for all ordered cuts."""

    cuts: list[float]
    weights: dict[str, float] = field(default_factory=dict)

    def __post_init__(self):
        self.heads = {w[: STEMS[0]] for w in self.weights}

    def expected(self, text: str | None, window: int = WINDOW) -> float:
        """Expected severity, the sum over cuts of P(grade >= k), of the worst stretch of
        ``window`` words. Stretches begin at every half of one and cover the whole text,
        so a passage is not thinned by what stands around it."""
        words, k = words_of(text), STEMS[0]
        held = [(i, w) for i, w in enumerate(words) if w[:k] in self.heads]
        worst, step, low, last = 0.0, max(1, window // 2), 0, max(0, len(words) - window)
        for start in range(0, last + step, step):
            start = min(start, last)
            while low < len(held) and held[low][0] < start:
                low += 1
            if low == len(held):
                break
            found: dict[str, int] = {}
            for i, w in held[low:]:
                if i >= start + window:
                    break
                found[w] = found.get(w, 0) + 1
            total = min(window, len(words))
            worst = max(worst, sum(self.weights.get(f, 0.0) * weighed(n, total) for f, n in features_of(found).items()))
        return sum(_sigmoid(worst - c) for c in self.cuts)


def _sigmoid(z: float) -> float:
    return 1 / (1 + math.exp(-z)) if z >= 0 else math.exp(z) / (1 + math.exp(z))


def screen(rows: DataFrame, yes: int, no: int, most: int) -> list[str]:
    """The features that mark toxic texts best, by chi-square: at least four times as frequent
    there, in one of twenty toxic texts, and in one of 400 texts (or three) at least. Counted
    by Spark; the driver gets the ``most`` best."""

    def spread(batches):
        for batch in batches:
            for t, y in zip(batch["x"], batch["y"], strict=True):
                yield pd.DataFrame({"f": list(features_of(Counter(words_of(t)))), "y": y})

    a, b = F.col("a"), F.col("b")
    seen = rows.mapInPandas(spread, "f string, y int").groupBy("f").agg(F.sum(1 - F.col("y")).alias("a"), F.sum("y").alias("b"))
    fair = (a + b >= max(3, (yes + no) // 400)) & (b * 20 >= yes) & (b * no > 4 * a * yes)
    gap = (b * no - a * yes).cast("double")
    chi = gap * gap / ((a + b) * F.greatest(F.lit(yes + no) - a - b, F.lit(1)))
    best = seen.filter(fair).orderBy(chi.desc(), "f").limit(most)
    return sorted(r["f"] for r in best.select("f").collect())


def grades(texts: list[dict[str, float]], toxic: np.ndarray, levels: int, fold: np.ndarray) -> np.ndarray:
    """Ordered grades from yes/no labels: 0 if not toxic, else 1..levels by how much of
    what marks toxic texts of the other ``fold`` there is (features of log odds over 2.5).

    So no text is graded by odds that its own label went into. The cuts are quantiles of
    that amount among toxic texts that have any.
    """
    amount = np.zeros(len(texts))
    for mine in np.unique(fold).tolist():
        seen: dict[str, list[int]] = {}
        of = [0, 0]
        for found, y, f in zip(texts, toxic.tolist(), fold.tolist(), strict=True):
            if f != mine:
                of[y] += 1
                for w in found:
                    seen.setdefault(w, [0, 0])[y] += 1
        odds = {w: math.log((b + 0.5) / (of[1] + 1)) - math.log((a + 0.5) / (of[0] + 1)) for w, (a, b) in seen.items()}
        for i in np.flatnonzero(fold == mine).tolist():
            amount[i] = sum(x for w, x in texts[i].items() if odds.get(w, 0.0) > 2.5)
    out, some = toxic.astype(np.int64).copy(), (toxic > 0) & (amount > 0)
    if some.any():
        cuts = np.quantile(amount[some], np.arange(1, levels) / levels)
        out[some] = 1 + (amount[some][:, None] > cuts[None, :]).sum(axis=1)
    return out


def fit(
    texts: list[dict[str, float]], grade: np.ndarray, levels: int, kept: list[str], sparsity: float, steps: int = 600, weight: np.ndarray | None = None
) -> Model:
    """Proximal gradient descent with momentum on the cumulative-link likelihood.

    The loss of a text is the sum over cuts of the logistic loss of "at or above the
    cut", sharing one weight vector; an L1 penalty of ``sparsity`` times the noise
    of a slope, sqrt(log(features) / texts), makes it sparse. Weights are not negative, so
    no harmless word outweighs a toxic one. Cuts stay in order. ``weight`` says how much
    each row counts, one if it says nothing.
    """
    index = {w: i for i, w in enumerate(kept)}
    weight = np.ones(len(texts)) if weight is None else weight
    n = float(weight.sum())
    share = np.array([weight[grade >= k].sum() for k in range(1, levels + 1)], dtype=float)
    if not n or not share[0] or not kept:
        return Model([10.0] * levels)
    cuts = -np.log((share + 0.5) / (n - share + 0.5))
    l1 = sparsity * math.sqrt(math.log(len(kept) + 2) / n)
    row = np.concatenate([np.full(sum(w in index for w in t), i) for i, t in enumerate(texts)]).astype(np.int64)
    column = np.array([index[w] for t in texts for w in t if w in index], dtype=np.int64)
    value = np.array([x for t in texts for w, x in t.items() if w in index], dtype=float)
    above = (grade[:, None] >= np.arange(1, levels + 1)[None, :]).astype(float)
    # Each slope has its own step: a bound on its curvature given all others.
    whole = np.bincount(row, weights=value, minlength=len(texts))
    curve = np.bincount(column, weights=value * (whole * weight)[row], minlength=len(kept)) * levels / 4 / n
    rate, w, t = 1 / np.maximum(curve, 1e-9), np.zeros(len(kept)), 1.0
    ahead = w
    for k in range(steps):
        z = np.bincount(row, weights=value * ahead[column], minlength=len(texts))
        p = 1 / (1 + np.exp(-np.clip(z[:, None] - cuts[None, :], -40, 40)))
        gap = (p - above) * weight[:, None] / n
        slope = np.bincount(column, weights=value * gap.sum(axis=1)[row], minlength=len(kept))
        # The last half refits what the first selected under a weaker penalty.
        chosen = (w > 0) if k >= steps // 2 else True
        weak = l1 / 5 if k >= steps // 2 else l1
        step = np.maximum(ahead - rate * (slope + weak), 0) * chosen
        cuts = np.maximum.accumulate(cuts + 4.0 * gap.sum(axis=0))
        t, last = (1 + math.sqrt(1 + 4 * t * t)) / 2, t
        if ((ahead - step) * (step - w)).sum() > 0:
            t = last = 1.0  # overshot: drop the momentum
        w, ahead = step, step + (last - 1) / t * (step - w)
    return Model([float(c) for c in cuts], {k: float(x) for k, x in zip(kept, w, strict=True) if x > 1e-6})


def stretches(words: list[str], most: int | None = None, window: int = WINDOW) -> list[list[str]]:
    """The stretches that ``Model.expected`` scores; at most ``most``, evenly spread."""
    step, last = max(1, window // 2), max(0, len(words) - window)
    starts = list(dict.fromkeys(min(start, last) for start in range(0, last + step, step)))
    if most is not None and len(starts) > most:
        starts = [starts[i * len(starts) // most] for i in range(most)]
    return [words[a : a + window] for a in starts]


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "toxic",
    levels: int = 3, sample_rows: int = 4000, max_features: int = 2000, sparsity: float = 0.03, sample_stretches: int = 12,
) -> Model:
    """Fit to at most ``sample_rows`` labelled documents that have a text, whose screened features are
    what reaches the driver. They are the least by a hash of the id, so reruns agree,
    at any size of the corpus; features are ``max_features`` at most.

    What is scored later is a stretch of a text, so stretches are what is learned: of a clean
    text up to ``sample_stretches``, all clean, and of a toxic one the stretch that a first
    fit, to whole texts, finds worst.

    An id labelled twice counts as toxic if any label says so, one with several texts takes the least; null labels, ids and texts are left out. Without
    a toxic label the model keeps every document, with a warning.
    """
    y = F.max((quoted(label) > 0).cast("int")).alias("y")
    known = labels.filter(quoted(label).isNotNull() & quoted(id_col).isNotNull()).groupBy(quoted(id_col).alias("k")).agg(y)
    texts = docs.select(quoted(id_col).alias("d"), quoted(text).alias("x")).filter("x is not null")
    present = known.join(texts.select("d"), F.col("k") == F.col("d"), "left_semi")
    chosen = present.orderBy(F.xxhash64("k"), "k").limit(sample_rows)
    rows = texts.join(F.broadcast(chosen), F.col("d") == F.col("k")).groupBy("k", "y").agg(F.min("x").alias("x"))

    rows = stage(rows, "labelled")
    sizes = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    if not sizes.get(1):
        warnings.warn("no text is labelled toxic: the model keeps every document", stacklevel=2)
    features = screen(rows, sizes.get(1, 0), sizes.get(0, 0), max_features)
    known_features = frozenset(features)

    def count(batches):
        for batch in batches:
            rows = []
            for k, t, y in zip(batch["k"].astype(str), batch["x"], batch["y"], strict=True):
                words = words_of(t)
                parts = [words, *stretches(words, sample_stretches)]
                for n, part in enumerate(parts):
                    found = {f: weighed(c, len(part)) for f, c in features_of(Counter(part)).items() if f in known_features}
                    rows.append((k, n, y, list(found), list(found.values())))
            yield pd.DataFrame(rows, columns=["k", "n", "y", "f", "v"])

    got = sorted(rows.mapInPandas(count, "k string, n int, y int, f array<string>, v array<double>").collect(), key=lambda r: (r["k"], r["n"]))
    held = [(r["k"], r["n"], r["y"], dict(zip(r["f"], r["v"], strict=True))) for r in got]

    def fitted(texts: list[tuple]) -> Model:
        toxic = np.array([y for _, _, y, _ in texts], dtype=np.int64)
        fold = np.array([zlib.crc32(k.encode()) & 1 for k, _, _, _ in texts], dtype=np.int64)
        found = [x for _, _, _, x in texts]
        rows_of = Counter(k for k, _, _, _ in texts)
        weight = np.array([1 / rows_of[k] for k, _, _, _ in texts])  # a text counts once
        return fit(found, grades(found, toxic, levels, fold), levels, features, sparsity, weight=weight)

    first = fitted([r for r in held if r[1] == 0])
    worst: dict[str, tuple] = {}
    for r in held:
        if r[1] and r[2]:
            amount = sum(first.weights.get(f, 0.0) * x for f, x in r[3].items())
            if r[0] not in worst or amount > worst[r[0]][0]:
                worst[r[0]] = (amount, r)
    return fitted(sorted([r for r in held if r[1] and not r[2]] + [r for _, r in worst.values()], key=lambda r: (r[0], r[1])))


def score(docs: DataFrame, model: Model, text: str = "text", least: float = 0.5) -> DataFrame:
    """Add ``severity`` (expected grade), ``grade`` (rounded) and ``toxic``
    (``severity >= least``) to every row; none is dropped.

    Row by row in Arrow batches: no shuffle. The model that tasks get holds at most
    the words it was fitted with, so its size has a bound. Null and empty texts have
    the base severity of a text without words; long texts are read whole, stretch by
    stretch; repeated
    rows score alike. Input columns named like an added one are replaced. An empty
    table gives an empty result.
    """

    @F.pandas_udf("double")
    def severity(texts: pd.Series) -> pd.Series:
        return pd.Series([model.expected(t) for t in texts], dtype="float64")

    added = ("severity", "grade", "toxic")
    out = without(docs, *[a for a in added if a != text]).withColumn("severity", severity(quoted(text)))
    rounded = F.least(F.round("severity"), F.lit(len(model.cuts))).cast("int")
    return out.withColumn("grade", rounded).withColumn("toxic", F.col("severity") >= least)


def keep(docs: DataFrame, model: Model, text: str = "text", least: float = 0.5) -> DataFrame:
    """The rows that are not toxic, with the columns they came with."""

    @F.pandas_udf("boolean")
    def fine(texts: pd.Series) -> pd.Series:
        return pd.Series([model.expected(t) < least for t in texts], dtype=bool)

    return docs.filter(fine(quoted(text)))
