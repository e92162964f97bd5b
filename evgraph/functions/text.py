"""Text functions of the engine, as column expressions where Spark has the parts."""

from __future__ import annotations

import json
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words of a question that name nothing.
STOP_WORDS = (
    "a an and are as at be by do does for from how in is it its of on or that the this to what where "
    "which who whom why with talks talk uses use call calls"
).split()


def marked(lines: DataFrame, key: list[str], line: str, markers: str, most: int = 200) -> DataFrame:
    """``key``, ``kind``, ``said`` of lines that one of ``markers`` (a pattern) opens: which
    one, and the first ``most`` characters after it."""
    opens = rf"(?i)^[ \t]*({markers})\b"
    whole = opens + "[ :]*(.*)$"
    said = F.left(F.regexp_extract(line, whole, 2), F.lit(most))
    return lines.filter(F.col(line).rlike(opens)).select(*key, F.regexp_extract(line, whole, 1).alias("kind"), said.alias("said"))


def tokens(text: Column, keep_whole: bool = False) -> Column:
    """Identifier-aware words: camel case and underscores split, lower case, longer
    than one letter, no stop words; repeats stay. ``keep_whole`` adds unsplit words."""
    plain = F.replace(text, F.lit("_"), F.lit(" "))
    spaced = F.regexp_replace(plain, "(?<=[a-z0-9])(?=[A-Z])", " ")
    found = F.regexp_extract_all(F.lower(spaced), F.lit("[a-z0-9]+"), 0)
    if keep_whole:
        found = F.concat(found, F.regexp_extract_all(F.lower(plain), F.lit("[a-z0-9]+"), 0))
    return F.filter(found, lambda w: (F.length(w) > 1) & ~w.isin(STOP_WORDS))


def matches(word: Column, found: Column, length: int) -> Column:
    """Whether a word is a token, or part of one when four letters or longer."""
    same = F.array_contains(found, word)
    return same | F.exists(found, lambda t: F.contains(t, word)) if length >= 4 else same


def escape_field(text: Column) -> Column:
    r"""Backslash, tab, line feed and carriage return as \\ \t \n \r."""
    for raw, shown in (("\\", "\\\\"), ("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r")):
        text = F.replace(text, F.lit(raw), F.lit(shown))
    return text


def unescape_field(text: Column) -> Column:
    """The reverse in one pass: pieces between escapes are joined around them."""
    parts = F.regexp_extract_all(text, F.lit(r"(\\.|[^\\]+)"), 1)
    plain = lambda x: (
        F.when(x == "\\\\", "\\").when(x == "\\t", "\t").when(x == "\\n", "\n").when(x == "\\r", "\r").otherwise(x)
    )
    return F.array_join(F.transform(parts, plain), "")


def bad_escape(text: Column) -> Column:
    """Whether a field holds an unknown or unfinished escape."""
    return F.regexp_replace(text, r"\\[\\tnr]", "").contains("\\")


def blank_digits(text: Column) -> Column:
    return F.regexp_replace(text, r"\d+", "#")


@F.pandas_udf(T.StringType())
def nfc_path(paths: pd.Series) -> pd.Series:
    """Paths in normal form C with forward slashes."""
    return paths.map(lambda p: None if p is None else unicodedata.normalize("NFC", p.replace("\\", "/")))


@F.pandas_udf(T.StringType())
def folded(names: pd.Series) -> pd.Series:
    """Normal form C, case folded: the key by which names collide."""
    return names.map(lambda n: None if n is None else unicodedata.normalize("NFC", n).casefold())


@F.pandas_udf(T.LongType())
def json_cost(rows: pd.DataFrame) -> pd.Series:
    """Tokens of a struct printed as indented JSON, a quarter of its characters."""

    def cost(row: dict) -> int:
        shown = json.dumps(row, indent=2, default=str)
        return (len(shown) + 4 * shown.count("\n")) // 4

    return pd.Series([cost(r) for r in rows.astype(object).where(rows.notna(), None).to_dict("records")])
