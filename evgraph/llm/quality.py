"""Quality rules: a table of thresholds compiled into one native projection."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evgraph.llm.common import SPACE, quoted, without, words_of

# Frequent function words of the four languages of the corpus.
STOP_WORDS = {
    "en": "the of and to in is that it for as was with be by on not he his but at are this have from or had an they which you were all we can her has there been if more when will would who so no",
    "fr": "le la les de des du un une et en que qui dans pour par sur pas au aux ce il elle est sont avec plus se ne son sa ses ou mais nous vous",
    "de": "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über",
    "es": "el la los las de del y que en un una por con no para se su al lo como más pero sus le ya o este sí porque esta entre cuando muy sin sobre también me",
}


@dataclass(frozen=True)
class Rule:
    """Keep a text while ``least <= metric <= most``; None leaves a side open."""

    metric: str
    least: float | None = None
    most: float | None = None


#: The threshold table. Metrics are the columns that ``metrics`` makes.
RULES = (
    Rule("n_words", least=50),
    Rule("mean_word_chars", least=1.5, most=25),
    Rule("symbols_per_word", most=0.1),
    Rule("marks_per_word", most=0.5),
    Rule("stop_word_ratio", least=0.02),
    Rule("dup_line_ratio", most=0.5),
    Rule("repeat_word_ratio", most=0.5),
)


def _bind(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body`` as a lambda variable."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeat_words(words: Column) -> Column:
    """Positions covered by three-word windows that occur twice or more.

    Windows are sorted with their positions, so equal ones are neighbours: the
    work is n log n in the words of one text and needs no shuffle.
    """

    def marked(s: Column) -> Column:
        same = lambda x, at: F.coalesce(F.get(s, at).h == x.h, F.lit(False))
        return F.transform(F.filter(s, lambda x, i: same(x, i - 1) | same(x, i + 1)), lambda x: x.i)

    def covered(starts: Column) -> Column:
        step = lambda x, i: F.least(F.lit(3), F.coalesce(F.get(starts, i + 1) - x, F.lit(3)))
        return F.aggregate(F.transform(starts, step), F.lit(0).cast("long"), lambda a, x: a + x)

    def repeated(h: Column) -> Column:
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        found = _bind(pairs, lambda s: _bind(F.array_sort(marked(s)), covered))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(found)

    windows = F.transform(
        F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0))),
        lambda x, i: F.xxhash64(x, F.get(words, i + 1), F.get(words, i + 2)),
    )
    return _bind(windows, repeated)


def metrics(text: Column) -> Column:
    """One struct of the counts of a whole text. Null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    stops = sorted(set(" ".join(STOP_WORDS.values()).split()))
    chars = lambda kept: F.char_length(F.regexp_replace(text, f"[^{kept}]+", "")).cast("long")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACE[1:-1]}]"))

    def of_words(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
            _repeat_words(w).alias("n_repeat_words"),
            F.size(F.filter(w, lambda x: F.lower(x).isin(stops))).cast("long").alias("n_stop_words"),
        )

    def of_lines(x: Column) -> Column:
        return F.struct(
            F.size(x).cast("long").alias("n_lines"),
            (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        )

    return F.struct(
        _bind(words_of(text), of_words).alias("w"),
        _bind(lines, of_lines).alias("l"),
        chars("#*$%&|<>").alias("n_symbols"),
        chars("!").alias("n_marks"),
    )


def verdict(m: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """The threshold table as one boolean over a struct of ``metrics``."""
    words = F.greatest(m.w.n_words, F.lit(1))
    ratios = {
        "n_words": m.w.n_words,
        "mean_word_chars": m.w.word_chars / words,
        "symbols_per_word": m.n_symbols / words,
        "marks_per_word": m.n_marks / words,
        "stop_word_ratio": m.w.n_stop_words / words,
        "dup_line_ratio": m.l.n_dup_lines / F.greatest(m.l.n_lines, F.lit(1)),
        "repeat_word_ratio": m.w.n_repeat_words / words,
    }
    passed = F.lit(True)
    for rule in rules:
        if rule.least is not None:
            passed = passed & (ratios[rule.metric] >= F.lit(rule.least))
        if rule.most is not None:
            passed = passed & (ratios[rule.metric] <= F.lit(rule.most))
    return passed


#: The columns that ``score`` adds.
ADDED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def score(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Add the counts of each whole text, ``base_failed`` and ``kept``; drop no row.

    One narrow projection without user functions: no shuffle, any row count.

    Null and empty texts have no words, so they fail the base rule. Repeated rows
    are judged alike, one by one. Columns of the input named like an added one (in
    any case) are replaced; all others pass through. An empty table gives an empty
    result. A text of n words takes O(n log n).
    """
    value = F.array(metrics(quoted(text)))
    rest = without(docs, *ADDED)
    base = lambda m: (m.w.n_words < 50) | (100 * m.w.n_repeat_words > 50 * m.w.n_words)
    done = F.transform(
        value,
        lambda m: F.struct(
            m.w.n_words.alias("n_words"),
            m.w.word_chars.alias("word_chars"),
            m.n_symbols.alias("n_symbols"),
            m.l.n_dup_lines.alias("n_dup_lines"),
            m.w.n_repeat_words.alias("n_repeat_words"),
            base(m).alias("base_failed"),
            (~base(m) & verdict(m, rules)).alias("kept"),
        ),
    )
    if text.lower() in {a.lower() for a in ADDED}:
        raise ValueError(f"the text column may not be named {text}")
    return rest.select("*", F.inline(done))


def keep(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows whose text passes, with the columns they came with."""
    value = F.array(metrics(quoted(text)))
    fine = lambda m: (m.w.n_words >= 50) & (100 * m.w.n_repeat_words <= 50 * m.w.n_words) & verdict(m, rules)
    return docs.filter(F.element_at(F.transform(value, fine), 1))
