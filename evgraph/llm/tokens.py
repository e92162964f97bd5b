"""Byte-level BPE: ids of whole texts, and token counts by field or section."""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evgraph.llm.common import quoted, without

#: Longest text that the fast encoder is given; it may fail on longer runs without a
#: break. Both encoders give the same ids.
_LONG_RUN = 1 << 20


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_of_char() -> dict[str, int]:
    """Byte-level vocabularies write bytes that don't print as code points from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """The ids that a byte-level BPE file of the tokenizers library gives a text,
    without tokens that are added around it.

    Its merges are run by tiktoken, about four times as fast on one core, which
    gives equal ids because the file ranks merges in the order of ids (checked
    when it is loaded, else the tokenizers library itself is used). A string of a
    special token in a text is that token, as the library has it by default.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, byte = spec["model"], _byte_of_char()
        added = spec.get("added_tokens", [])
        special = {t["content"]: t["id"] for t in added}
        ranks = {bytes(byte[c] for c in t): i for t, i in model["vocab"].items() if t not in special}
        self.bytes_of = np.zeros(max([*model["vocab"].values(), *special.values()], default=0) + 1, dtype=np.int64)
        for t, i in [*ranks.items(), *((t.encode(), i) for t, i in special.items())]:
            self.bytes_of[i] = len(t)
        self.fast, self.special = None, tuple(special)
        merged = [m if isinstance(m, str) else " ".join(m) for m in model.get("merges", [])]
        in_order = all(model["vocab"].get(m.replace(" ", "")) == 256 + i for i, m in enumerate(merged))
        pre = spec.get("pre_tokenizer") or {}
        plain = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        whole = not any(t.get(k) for t in added for k in ("single_word", "lstrip", "rstrip"))
        if in_order and plain and whole and not spec.get("normalizer") and len(ranks) == 256 + len(merged):
            import tiktoken
            from public_tokenizers import PATTERN

            self.fast = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def ids(self, text: str) -> np.ndarray:
        if self.fast is not None and len(text) <= _LONG_RUN:
            if any(t in text for t in self.special):
                return np.array(self.fast.encode(text, allowed_special="all"), dtype=np.uint32)
            return np.array(self.fast.encode_ordinary(text), dtype=np.uint32)
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, dtype=np.uint32)


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def char_spans(text: str, ids: np.ndarray, e: Encoder) -> tuple[np.ndarray, np.ndarray]:
    """First and one past the last character that each token has a byte of."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    char = np.cumsum((raw & 0xC0) != 0x80) - 1
    ends = np.cumsum(e.bytes_of[ids])
    if len(ends) and ends[-1] != len(raw):
        raise ValueError("the tokens don't spell the text")
    starts = ends - e.bytes_of[ids]
    return char[starts], char[ends - 1] + 1


#: How a token over a boundary is allotted.
RULES = ("start", "end", "most")


def attribute(starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray, rule: str) -> np.ndarray:
    """The section of every token: ``bounds`` are section starts, ascending from 0.

    ``start``: the section of its first character. ``end``: of its last. ``most``:
    the one with most of its characters, the earlier one when equal.
    """
    first = np.searchsorted(bounds, starts, side="right") - 1
    last = np.searchsorted(bounds, np.maximum(ends - 1, starts), side="right") - 1
    if rule == "start":
        return first
    if rule == "end":
        return last
    out = first.copy()
    limits = np.append(bounds, np.iinfo(np.int64).max)
    for t in np.flatnonzero(first != last):
        over = [min(ends[t], limits[s + 1]) - max(starts[t], limits[s]) for s in range(first[t], last[t] + 1)]
        out[t] = first[t] + int(np.argmax(over))
    return out


def section_tokens(
    docs: DataFrame, section_bounds, id_col: str = "doc_id", text: str = "text", rule: str = "start", path: str | None = None
) -> DataFrame:
    """Token counts by section of each text: one row per document and section.

    ``section_bounds(text)`` gives ``[(name, start), ...]`` by ascending character
    offset, the first at 0. A document is encoded once, whole; the spans of its
    tokens are joined to the sections as sorted intervals, and every token counts
    in exactly one by ``rule`` (see ``attribute``), so the counts of a document add
    up to its length in tokens. ``n_crossing`` counts tokens of the section that
    reach over a boundary.

    Row by row, in bounded Arrow batches: no shuffle. Null and empty texts give one
    section without tokens; long texts are encoded whole; repeated rows count one by
    one; null ids are kept; other columns are left out; an empty table gives none.
    """
    if rule not in RULES:
        raise ValueError(f"the rule is one of {RULES}")
    file = path or default_path()
    kind = "array<struct<section:string,section_start:long,n_chars:long,n_tokens:long,n_crossing:long>>"

    @F.pandas_udf(kind)
    def count(texts: pd.Series) -> pd.Series:
        e, out = encoder(file), []
        for t in texts:
            t = t or ""
            names, bounds = zip(*section_bounds(t), strict=True)
            bounds, ids = np.array(bounds, dtype=np.int64), e.ids(t)
            starts, ends = char_spans(t, ids, e)
            at = attribute(starts, ends, bounds, rule)
            reach = np.searchsorted(bounds, np.maximum(ends - 1, 0), side="right") != np.searchsorted(bounds, starts, side="right")
            tokens, over = np.bincount(at, minlength=len(bounds)), np.bincount(at[reach], minlength=len(bounds))
            sizes = np.diff(np.append(bounds, len(t)))
            out.append(
                [
                    {"section": n, "section_start": int(b), "n_chars": int(c), "n_tokens": int(k), "n_crossing": int(o)}
                    for n, b, c, k, o in zip(names, bounds, sizes, tokens, over, strict=True)
                ]
            )
        return pd.Series(out)

    chosen = docs.select(quoted(id_col).alias(id_col), count(quoted(text)).alias("__evgraph_sections"))
    return chosen.select(id_col, F.inline("__evgraph_sections"))


def head_and_body(text: str) -> list[tuple[str, int]]:
    """The first line, its line end included, and the rest."""
    cut = text.find("\n") + 1
    return [("head", 0), ("body", cut)] if 0 < cut < len(text) else [("head", 0)]


__all__ = ["Encoder", "attribute", "char_spans", "encoder", "head_and_body", "section_tokens", "without"]
