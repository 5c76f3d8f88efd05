"""Operator 7: chat formatting by incremental black-box rendering.

A template is any function from turns to text. It is rendered over successive prefixes of a conversation; what a
prefix adds to the one before is a turn's span, and a template that changes what it has written is told by it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Turn = tuple[str, str]
Template = Callable[[list[Turn], str | None], str]

_BEGIN, _END = "<|im_start|>", "<|im_end|>\n"
_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)


def escape(text: str) -> str:
    """``text`` without the strings that open a control string; each gets one backslash more."""
    return re.sub(r"<(\\*)\|", r"<\1\\|", text)


def unescape(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text)


def _escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def chatml(turns: list[Turn], opening: str | None = None) -> str:
    """The built-in template; ``opening`` also opens a turn of that role."""
    done = "".join(f"{_BEGIN}{_escape_role(r)}\n{escape(t)}{_END}" for r, t in turns)
    return done if opening is None else f"{done}{_BEGIN}{_escape_role(opening)}\n"


#: What it writes for a turn depends on nothing but the turn.
chatml.turnwise = True


class RewritesHistory(ValueError):
    """A prefix's rendering is not the beginning of the next one's."""


def render_spans(turns: list[Turn], template: Template = chatml, learn_roles: tuple[str, ...] = ("assistant",), context: int = 64) -> tuple[str, list[tuple[int, int]], list[tuple[int, int]]]:
    """The formatted conversation, each turn's span in it, and the spans of the texts to learn.

    All prefixes are rendered from the first turn. For a template that says it is ``turnwise`` they start anew
    every ``context`` turns, so that the work grows with the conversation and not with its square; a text that
    then differs from the rendering of the whole conversation is not used, and all prefixes are rendered.
    """
    if getattr(template, "turnwise", False) and context < len(turns):
        windows = _spans(turns, template, learn_roles, context)
        if windows[0] == template(turns, None):
            return windows
    return _spans(turns, template, learn_roles, max(1, len(turns)))


def _spans(turns: list[Turn], template: Template, learn_roles: tuple[str, ...], context: int) -> tuple[str, list[tuple[int, int]], list[tuple[int, int]]]:
    """As ``render_spans``, with prefixes that start anew every ``context`` turns."""
    pieces: list[str] = []
    spans: list[tuple[int, int]] = []
    loss: list[tuple[int, int]] = []
    at = 0
    opening = len(template([], None))
    for first in range(0, len(turns), context):
        some = turns[first : first + context]
        before = template([], None)
        if not first:
            pieces.append(before)
            at = len(before)
        for k, (role, _) in enumerate(some):
            after = template(some[: k + 1], None)
            if not after.startswith(before):
                raise RewritesHistory(f"turn {first + k} changes what the template wrote for the turns before it")
            if role in learn_roles:
                opened = template(some[:k], role)
                empty = template([*some[:k], (role, "")], None)
                if not (after.startswith(opened) and empty.startswith(opened) and after.endswith(empty[len(opened) :])):
                    raise RewritesHistory(f"turn {first + k}: its text does not stand between a fixed head and tail")
                shift = at - len(before)
                loss.append((shift + len(opened), shift + len(after) - (len(empty) - len(opened))))
            pieces.append(after[len(before) :])
            spans.append((at, at + len(after) - len(before)))
            at += len(after) - len(before)
            before = after
    if not turns:
        pieces, at = [template([], None)], opening
    return "".join(pieces), spans, loss


def format_chats(rows: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", template: Template = chatml) -> DataFrame:
    """``conv_id, formatted, turn_spans, loss_spans`` of each conversation; spans are ``array<struct<start, end>>``.

    Turns go by ``turn``, ties by role and text; null roles and texts are empty, null turns come first, and each row
    without a ``conv_id`` is a conversation of its own. Repeated rows are turns of their own. Rows reach Python sorted and
    in batches, so that only the conversation at hand is in memory, which as one formatted text has to fit, however
    long its texts. Other columns are ignored; an empty table gives no rows.
    """
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    alone = F.when(F.col(conv_id).isNull(), F.monotonically_increasing_id()).otherwise(-1)
    own = rows.select(F.col(conv_id).cast("long").alias("conv"), alone.alias("alone"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, turns, begun = None, [], False

        def done(out: list) -> None:
            if begun:
                formatted, spans, loss = render_spans(turns, template)
                out.append((key[0], formatted, [{"start": a, "end": b} for a, b in spans], [{"start": a, "end": b} for a, b in loss]))

        def batch_of(out: list) -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) if out else [(), (), (), ()]
            kinds = (pa.int64(), pa.string(), span, span)
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=["conv_id", "formatted", "turn_spans", "loss_spans"])

        for batch in batches:
            out: list = []
            for conv, alone, _, r, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not begun or (conv, alone) != key:
                    done(out)
                    key, turns, begun = (conv, alone), [], True
                turns.append((r, t))
            yield batch_of(out)
        last: list = []
        done(last)
        yield batch_of(last)

    schema = "conv_id long, formatted string, turn_spans array<struct<start: long, end: long>>, loss_spans array<struct<start: long, end: long>>"
    return own.repartition("conv", "alone").sortWithinPartitions("conv", "alone", "turn", "role", "text").mapInArrow(run, schema)


def parse(formatted: str) -> list[Turn]:
    """The turns of a text that ``chatml`` formatted."""
    return [(_unescape_role(r), unescape(t)) for r, t in _TURN.findall(formatted)]


def read_back(formatted: Column, loss_spans: Column) -> Column:
    """What the output says: number and digest of its turns, size and digest of the text to learn, size in all."""

    @F.pandas_udf("n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    def run(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
        out = []
        for t, own in zip(texts, spans, strict=True):
            turns = parse(t)
            said = hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest()
            loss = "".join(unescape(t[s["start"] : s["end"]]) for s in own)
            out.append((len(turns), said, len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(t)))
        return pd.DataFrame(out, columns=["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return run(formatted, loss_spans)
