"""Operator 6: secret scanning by patterns and by character Markov models.

Three patterns give the base spans. Besides, runs of token characters are judged by two first-order Markov
models, of random strings and of ordinary identifiers: a mean log-likelihood ratio above a threshold marks one.
"""

from __future__ import annotations

import math
import random
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The kinds in their order, their patterns and least lengths.
KINDS = ("assign", "access", "hex", "markov")
_ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ASSIGN_LEAST = 12
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")
_NAMES = ("password", "passwd", "secret", "token", "api_key", "apikey")
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
_SYMBOLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
_IDENTIFIER = re.compile(r"[A-Za-z][A-Za-z0-9_-]{5,}")

Span = tuple[str, int, int]


def _base(text: str) -> list[tuple[str, int, int, int]]:
    """Leftmost non-overlapping matches of each kind that are long enough; last, where the secret itself begins."""
    out: list[tuple[str, int, int, int]] = []
    low = text.lower()
    if any(n in low for n in _NAMES):
        out += [("assign", m.start(), m.end(), m.start(2)) for m in _ASSIGN.finditer(text) if len(m[2]) >= _ASSIGN_LEAST]
    if "AKIA" in text:
        out += [("access", m.start(), m.end(), m.start()) for m in _ACCESS.finditer(text)]
    out += [("hex", m.start(), m.end(), m.start()) for m in _HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def base_spans(text: str) -> list[Span]:
    """The base matches, in code points, by start and then kind."""
    return [s[:3] for s in _base(text)]


class MarkovRatio:
    """Mean log-likelihood ratio per step of a string: random over ordinary. Transitions are smoothed towards the
    symbol's own frequency in their model, with the weight of ``backing`` observations."""

    def __init__(self, random_strings: Iterable[str], ordinary: Iterable[str], backing: float = 5.0):
        self.ratio: dict[str, float] = {}
        for sign, strings in ((1, random_strings), (-1, ordinary)):
            pairs, single = Counter(), Counter(_SYMBOLS)
            for s in strings:
                single.update(s)
                pairs.update(s[i : i + 2] for i in range(len(s) - 1))
            total = sum(single[c] for c in _SYMBOLS)
            for a in _SYMBOLS:
                after = sum(pairs[a + b] for b in _SYMBOLS)
                for b in _SYMBOLS:
                    chance = (pairs[a + b] + backing * single[b] / total) / (after + backing)
                    self.ratio[a + b] = self.ratio.get(a + b, 0.0) + sign * math.log(chance)

    def __call__(self, s: str) -> float:
        steps = [self.ratio.get(s[i : i + 2], 0.0) for i in range(len(s) - 1)]
        return sum(steps) / max(1, len(steps))


def learn(texts: Iterable[str | None], *, drawn: int = 3000, seed: int = 7) -> MarkovRatio:
    """Models from labelled strings: as random, ``drawn`` strings drawn evenly from the alphabets that keys use, and
    what the base patterns find in ``texts``; as ordinary, the identifiers of ``texts`` outside those spans."""
    draw = random.Random(seed)
    alphabets = (_SYMBOLS[:62], _SYMBOLS[:62] + "+/", _SYMBOLS[:62] + "_-", "0123456789abcdef", _SYMBOLS[:26] + "0123456789")
    secret = ["".join(draw.choices(alphabets[i % len(alphabets)], k=40)) for i in range(drawn)]
    ordinary: list[str] = []
    for t in texts:
        text, at = t or "", 0
        for _, start, end, value in _base(text):
            ordinary += _IDENTIFIER.findall(text[at:start])
            secret.append(text[value:end])
            at = max(at, end)
        ordinary += _IDENTIFIER.findall(text[at:])
    return MarkovRatio(secret, ordinary)


def all_spans(text: str, ratio: MarkovRatio, threshold: float) -> list[Span]:
    """Base spans, and candidate runs that touch none of them and are random by the models."""
    base = base_spans(text)
    starts, reach = [s for _, s, _ in base], list(accumulate((e for _, _, e in base), max))
    more: list[Span] = []
    for m in _CANDIDATE.finditer(text):
        before = bisect_left(starts, m.end())  # base spans that begin before the run ends
        if (not before or reach[before - 1] <= m.start()) and ratio(m[0]) > threshold:
            more.append(("markov", m.start(), m.end()))
    return sorted(base + more, key=lambda s: (s[1], KINDS.index(s[0]))) if more else base


def learn_from(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", rows: int = 1000) -> MarkovRatio:
    """Models from a bounded sample: the ``rows`` documents first in the order of a hash of their id."""
    ids = docs.select(F.col(doc_id).alias("id")).where("id is not null").distinct().orderBy(F.xxhash64("id"), "id").limit(rows)
    own = docs.select(F.col(doc_id).alias("doc"), F.col(text).alias("body")).join(F.broadcast(ids), F.col("doc") == F.col("id"), "left_semi")
    return learn(sorted({r.body or "" for r in own.select("body").collect()}))


def secret_spans(docs: DataFrame, ratio: MarkovRatio, *, text: str = "text", threshold: float = 1.0) -> Column:
    """Column ``array<struct<kind, start, end>>`` of each whole text's spans by start, then kind; ends exclusive.

    Null and empty texts have none. Texts are scanned one by one and whole, in time linear in their length; repeated
    rows give repeated results, an empty table none. The column may stand beside any others.
    """
    weights = ratio.ratio
    kind = "array<struct<kind: string, start: long, end: long>>"

    @F.pandas_udf(kind)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        judge = MarkovRatio((), ())
        judge.ratio = weights
        for batch in batches:
            yield pd.Series([[{"kind": k, "start": s, "end": e} for k, s, e in all_spans(t, judge, threshold)] if t else [] for t in batch], dtype="object")

    return run(docs[text])
