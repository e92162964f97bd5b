"""How wide a text is drawn in a monospace font, and cutting it to fit."""

from __future__ import annotations

import math
import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The width of a cell as a share of the font's size, what stands for a cut,
#: and what stands for a character that may not be drawn.
CELL, ELLIPSIS, REPLACED = 0.62, "\u2026", "\ufffd"
#: Marks that hide or change the direction of what follows, ends of lines.
_HIDING = "\u00ad\u061c\u200e\u200f\u202a\u202b\u202c\u202d\u202e\u2066\u2067\u2068\u2069\ufeff\u2028\u2029"


def _class(fits) -> str:
    """A character class of all code points that fit, as ranges made from the character
    database at hand."""
    ranges: list[list[int]] = []
    for c in range(sys.maxunicode + 1):
        if not 0xD800 <= c <= 0xDFFF and fits(chr(c)):
            if ranges and ranges[-1][1] == c - 1:
                ranges[-1][1] = c
            else:
                ranges.append([c, c])
    return "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" if a < b else f"\\x{{{a:x}}}" for a, b in ranges) + "]"


def _stacks(c: str) -> bool:
    return bool(unicodedata.combining(c)) or unicodedata.category(c) in ("Mn", "Me")


@lru_cache(maxsize=1)
def classes() -> tuple[str, str]:
    """Characters that take no cell, since they stack on the one before, and two cells."""
    return _class(_stacks), _class(lambda c: unicodedata.east_asian_width(c) in ("W", "F") and not _stacks(c))


def cells(text: Column) -> Column:
    """Cells that a text takes: two for wide characters, none for marks on others."""
    none, two = classes()
    size = lambda c: F.char_length(c)
    return size(F.regexp_replace(text, none, "")) + size(text) - size(F.regexp_replace(text, two, ""))


def advance(text: Column, font_size: int) -> Column:
    """The drawn width in pixels, rounded up."""
    return F.ceil((cells(text) * font_size).cast("double") * F.lit(CELL)).cast("int")


def truncate(text: Column, font_size: int, most: int, keep_tail: bool = True) -> Column:
    """A text that is at most ``most`` pixels wide: itself, or its end after an ellipsis (its
    beginning before one, without ``keep_tail``). Marks cut off from what they stand on go
    too; where nothing fits the text is empty. Native: widths are summed over the
    characters, and the longest part that fits is kept."""
    none, two = classes()
    budget = most - _up(font_size)
    room = budget / (font_size * CELL)
    each = F.filter(F.split(text, ""), lambda c: c != "")
    wide = F.transform(F.reverse(each) if keep_tail else each, lambda c: F.struct(c.alias("c"), F.when(c.rlike(none), 0).when(c.rlike(two), 2).otherwise(1).alias("w")))
    start = F.struct(F.lit(0).alias("w"), F.lit(0).alias("n"), F.lit(True).alias("go"))

    def step(a: Column, x: Column) -> Column:
        fits = a.go & (a.w + x.w <= F.lit(room + 1e-9))
        return F.struct(F.when(fits, a.w + x.w).otherwise(a.w).alias("w"), F.when(fits, a.n + 1).otherwise(a.n).alias("n"), fits.alias("go"))

    n = F.aggregate(wide, start, step).n
    if keep_tail:
        kept = F.regexp_replace(F.substr(text, F.char_length(text) - n + 1, n), f"^{none}+", "")
        cut = F.concat(F.lit(ELLIPSIS), kept)
    else:
        kept = F.regexp_replace(F.substr(text, F.lit(1), n), f"{none}+$", "")
        cut = F.concat(kept, F.lit(ELLIPSIS))
    return F.when(advance(text, font_size) <= most, text).when((F.lit(budget) <= 0) | (kept == ""), "").otherwise(cut)


def _up(font_size: int) -> int:
    return math.ceil(font_size * CELL)


@lru_cache(maxsize=1)
def unsafe() -> str:
    """Characters that would break a line, turn its direction or can't be drawn."""
    return _class(lambda c: c in _HIDING or unicodedata.category(c) in ("Cc", "Co", "Cn"))


def sanitize(text: Column) -> Column:
    """A text to draw: each unsafe character becomes one that shows it was there. Markup is
    left as it is, for whoever writes it into a document."""
    return F.regexp_replace(text, unsafe(), REPLACED)
