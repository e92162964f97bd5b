"""Chat formatting that is proven by reading it back."""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evgraph.llm.common import quoted

#: Grammar: conversation = turn*; turn = "<s>" role "\n" text "</s>". Inside role and
#: text a backslash after "<" takes a control string out of force; each level of
#: escaping adds one, so escaped text can itself be escaped. In a role "<n>" is a
#: control string too: a line end.
OPEN, CLOSE = "<s>", "</s>"
_CONTROL = re.compile(r"<(\\*)(/?s)>")
_ESCAPED = re.compile(r"<\\(\\*)(/?s)>")
_ROLE_CONTROL = re.compile(r"<(\\*)(/?s|n)>")
_ROLE_ESCAPED = re.compile(r"<\\(\\*)(/?s|n)>|<n>")


def escape(text: str) -> str:
    return _CONTROL.sub(r"<\\\1\2>", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1\2>", text)


def escape_role(role: str) -> str:
    return _ROLE_CONTROL.sub(r"<\\\1\2>", role).replace("\n", "<n>")


def unescape_role(role: str) -> str:
    return _ROLE_ESCAPED.sub(lambda m: f"<{m[1]}{m[2]}>" if m[2] else "\n", role)


@dataclass
class Turn:
    role: str
    text: str
    start: int = 0
    end: int = 0  # of the text in the formatted string, markers excluded


class GrammarError(ValueError):
    pass


def parse(formatted: str) -> list[Turn]:
    """The turns of a formatted string, each with the span of its raw text."""
    turns, at = [], 0
    while at < len(formatted):
        if not formatted.startswith(OPEN, at):
            raise GrammarError(f"no turn at {at}")
        line = formatted.find("\n", at)
        stop = formatted.find(CLOSE, at)
        if line < 0 or stop < line:
            raise GrammarError(f"no role at {at}")
        role, text = formatted[at + len(OPEN) : line], formatted[line + 1 : stop]
        if OPEN in role or OPEN in text:
            raise GrammarError(f"a turn inside the turn at {at}")
        turns.append(Turn(unescape_role(role), unescape(text), line + 1, stop))
        at = stop + len(CLOSE)
    return turns


def render(role: str, text: str) -> str:
    """One turn, escaped as long as reading it back gives anything else."""
    shown_role, shown = role, text
    for _ in range(2):
        out = f"{OPEN}{shown_role}\n{shown}{CLOSE}"
        try:
            back = parse(out)
        except GrammarError:
            back = []
        if len(back) == 1 and (back[0].role, back[0].text) == (role, text):
            return out
        shown_role, shown = escape_role(role), escape(text)
    raise AssertionError("an escaped turn reads back as it was")


#: A formatted stretch of one conversation.
SEGMENT = "segment long, formatted string, loss_spans array<struct<start:int,end:int>>"


def format_conversations(
    turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", learn: str = "assistant", segment_chars: int = 1 << 20
) -> DataFrame:
    """Conversations as ``segment``, ``formatted`` and ``loss_spans``, by ``conv_id``.

    A conversation is the concatenation of its segments, each a whole number of
    turns and about ``segment_chars`` long, so one of any length streams through
    memory in pieces; spans count code points within the segment and cover the raw
    text of each turn of ``learn``. Every turn is parsed back when it is rendered and
    escaped until what is recovered is the source.

    One exchange by conversation, then a sort in which large conversations spill.
    Turns come by number, null first, ties by role, then text, so reruns agree and
    repeated rows stay repeated. Null text counts as empty, a null role as an empty
    one; null ids make up one conversation; texts of any length are formatted whole.
    Other columns are left out; an empty table gives an empty result.
    """

    def run(batches):
        now, number, parts, spans, size, out = None, 0, [], [], 0, []
        first = True

        def emit():
            return (now, number, "".join(parts), spans)

        for batch in batches:
            for k, r, t in zip(batch["c"], batch["r"], batch["x"], strict=True):
                k = None if pd.isna(k) else k
                if first or k != now:
                    if parts:
                        out.append(emit())
                    now, number, parts, spans, size, first = k, 0, [], [], 0, False
                elif size >= segment_chars:
                    out.append(emit())
                    number, parts, spans, size = number + 1, [], [], 0
                shown = render(r, t)
                if r == learn:
                    back = parse(shown)[0]
                    spans.append({"start": size + back.start, "end": size + back.end})
                parts.append(shown)
                size += len(shown)
                if len(out) >= 64 or sum(len(o[2]) for o in out) > 1 << 22:
                    yield pd.DataFrame(out, columns=["c", "segment", "formatted", "loss_spans"])
                    out = []
        if parts:
            out.append(emit())
        if out:
            yield pd.DataFrame(out, columns=["c", "segment", "formatted", "loss_spans"])

    kind = turns.select(quoted(conv)).schema[0].dataType.simpleString()
    rows = turns.select(
        quoted(conv).cast("string").alias("c"),
        quoted(turn).alias("n"),
        F.coalesce(quoted(role), F.lit("")).alias("r"),
        F.coalesce(quoted(text), F.lit("")).alias("x"),
    )
    n = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartition(n, "c").sortWithinPartitions("c", "n", "r", "x")
    made = placed.select("c", "r", "x").mapInPandas(run, f"c string, {SEGMENT}")
    return made.select(F.col("c").cast(kind).alias(conv), "segment", "formatted", "loss_spans")


def read_back(formatted: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Digests of what a formatted corpus says, taken from its text and spans alone.

    Takes what ``format_conversations`` gives, in its order: the segments of a
    conversation follow each other in one partition, numbered from 0, and anything
    else is an error. Streams: hashes are fed turn by turn and nothing but their states
    is kept. Null ids are one conversation; other columns are left out; an empty table
    gives an empty result.
    """
    import hashlib

    def run(batches):
        now, state, out, first, due = None, None, [], True, 0

        def close():
            return (now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4])

        for batch in batches:
            for k, number, shown, spans in zip(batch["c"], batch["segment"], batch["formatted"], batch["loss_spans"], strict=True):
                k = None if pd.isna(k) else k
                if first or k != now:
                    if state:
                        out.append(close())
                    now, state, first, due = k, [0, hashlib.sha256(), 0, hashlib.sha256(), 0], False, 0
                if number != due:
                    raise ValueError(f"segment {number} of a conversation comes where {due} is due")
                due += 1
                for t in parse(shown):
                    state[0] += 1
                    state[1].update(f"{t.role}\n{t.text}\n".encode("utf-8", "surrogatepass"))
                for s in spans:
                    said = unescape(shown[s["start"] : s["end"]])
                    state[2] += len(said)
                    state[3].update(said.encode("utf-8", "surrogatepass"))
                state[4] += len(shown)
            if len(out) > 1000:
                yield pd.DataFrame(out, columns=names)
                out = []
        if state:
            out.append(close())
        if out:
            yield pd.DataFrame(out, columns=names)

    names = ["c", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kind = formatted.select(quoted(conv)).schema[0].dataType.simpleString()
    made = formatted.select(quoted(conv).cast("string").alias("c"), "segment", "formatted", "loss_spans").mapInPandas(
        run, "c string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )
    return made.select(F.col("c").cast(kind).alias(conv), *names[1:])
