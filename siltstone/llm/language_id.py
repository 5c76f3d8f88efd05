"""Operator 3: language identification by cross-parsing.

For each language a suffix automaton holds a sample of labelled text. A text is parsed from left to right into
the longest phrases that occur in the sample; the language that needs the fewest phrases, normalised by the
length of the text and the size of the sample, wins. Symbols are the bytes of letters in UTF-8, so that any script
has its own, and a gap between words. Texts are parsed in lockstep over dense transition tables.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.common import held_out

_ASCII = bytes(b if b > 127 or chr(b).isalpha() else 32 for b in range(256))


def letters_of(text: str) -> bytes:
    """The runs of letters of a text, lower case, in UTF-8, a space between them."""
    low = text.lower()
    if not low.isascii():
        for c in {c for c in set(low) if c > "\x7f" and not c.isalpha()}:
            low = low.replace(c, " ")
    return b" ".join(low.encode().translate(_ASCII).split())


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the automaton of all substrings, by state; 0 is the start."""
    step: list[dict[int, int]] = [{}]
    link, longest, last = [-1], [0], 0
    for c in symbols:
        new = len(step)
        step.append({})
        link.append(0)
        longest.append(longest[last] + 1)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if longest[q] == longest[p] + 1:
                link[new] = q
            else:
                twin = len(step)
                step.append(dict(step[q]))
                link.append(link[q])
                longest.append(longest[p] + 1)
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return step


class CrossParser:
    """Phrase counts of texts against the samples of all languages. A table has a row of as many states as there are
    different symbols in the samples for each of up to two states a symbol."""

    def __init__(self, samples: dict[str, str]):
        self.languages = sorted(samples)
        folded = [letters_of(samples[k]) for k in self.languages]
        used = sorted(set(b"".join(folded)))
        self.symbol = np.zeros(256, dtype=np.uint8)  # 0: a symbol that no sample has
        self.symbol[used] = np.arange(1, len(used) + 1)
        self.width = len(used) + 1
        tables, self.start, base = [], [], 0
        for own in folded:
            steps = suffix_automaton(self.symbol[list(own)].tolist())
            table = np.zeros((len(steps), self.width), dtype=np.int64)
            first = np.zeros(self.width, dtype=np.int64)
            for c, s in steps[0].items():
                first[c] = s
            table[:] = ~(first + base)  # no way on: a new phrase starts, marked by the sign
            for s, ways in enumerate(steps):
                for c, to in ways.items():
                    table[s, c] = to + base
            tables.append(table)
            self.start.append(base)
            base += len(steps)
        whole = np.concatenate(tables) if tables else np.zeros((0, self.width), dtype=np.int64)
        self.table = whole.astype(np.int32 if base * self.width < 2**31 else np.int64).ravel()
        self.scale = np.array([math.log(max(2, len(own))) for own in folded])

    def _symbols(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all texts end to end, and each text's number of them."""
        own = [letters_of(t) for t in texts]
        return self.symbol[np.frombuffer(b"".join(own), dtype=np.uint8)], np.array([len(b) for b in own], dtype=np.int64)

    def _step(self, state: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        to = self.table[state * self.width + symbols]
        new = to < 0
        return np.where(new, ~to, to), new

    def _phrases(self, symbols: np.ndarray, begin: np.ndarray, size: np.ndarray, segment: int) -> np.ndarray:
        """Phrases by language and text. Segments of a text are parsed side by side, each from a new phrase on; then
        the phrase that runs into a segment is followed until a new one starts where one of the segment's own does:
        from there on both are the same. Texts in which that doesn't happen within a segment are parsed in one."""
        parts = -(-size // segment)
        owner = np.repeat(np.arange(len(size)), parts)
        number = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
        length = np.minimum(segment, size[owner] - number * segment)
        order = np.argsort(-length, kind="stable")
        lane = np.empty_like(order)
        lane[order] = np.arange(len(order))
        before, follows = np.where(number > 0, np.roll(lane, 1), -1)[order], (number + 1 < parts[owner])[order]
        owner, number, length = owner[order], number[order], length[order]
        start = begin[owner] + number * segment
        steps = int(length[0]) if len(length) else 0
        lanes = np.searchsorted(-length, -np.arange(steps), side="left")
        state = np.repeat(np.array(self.start, dtype=self.table.dtype)[:, None], len(owner), axis=1)
        bound = np.zeros((steps, len(self.languages), len(owner)), dtype=bool)
        for t in range(steps):
            n = int(lanes[t])
            state[:, :n], bound[t, :, :n] = self._step(state[:, :n], symbols[start[:n] + t])
        count = bound.sum(axis=0, dtype=np.int64) + (before < 0)
        odd: set[int] = set()
        lang, at = np.nonzero(np.broadcast_to(before >= 0, count.shape))
        carried = state[lang, before[at]]
        for t in range(steps):
            on = length[at] > t
            odd.update(owner[at[~on & follows[at]]].tolist())
            lang, at, carried = lang[on], at[on], carried[on]
            if not len(at):
                break
            carried, new = self._step(carried, symbols[start[at] + t])
            own = bound[t, lang, at]
            count[lang, at] += new.astype(np.int64) - own
            on = ~(new & own)
            lang, at, carried = lang[on], at[on], carried[on]
        odd.update(owner[at[follows[at]]].tolist())
        total = np.stack([np.bincount(owner, weights=c, minlength=len(size)) for c in count]) if len(self.languages) else np.zeros((0, len(size)))
        if odd:
            some = np.array(sorted(odd))
            total[:, some] = self._phrases(symbols, begin[some], size[some], int(size.max()))
        return total

    def parse(self, texts: list[str], segment: int = 1024) -> tuple[np.ndarray, np.ndarray]:
        """Normalised phrases by text and language, and whether a text has a letter."""
        symbols, size = self._symbols(texts)
        total = self._phrases(symbols, np.cumsum(size) - size, size, segment)
        return (total * self.scale[:, None] / np.maximum(1, size)).T, size > 0


def sample_texts(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", rows_per_language: int = 16, usual_chars: int = 8000) -> dict[str, str]:
    """Labelled text by language from documents that are not held out.

    The sample is bounded by rows: of each language the ``rows_per_language`` first in the order of a hash of their
    id, whole, those of up to ``usual_chars`` characters before longer ones. Null labels and texts are left out, and
    languages whose rows have no letter.
    """
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("body"), F.col(lang).cast("string").alias("lang"))
    rows = rows.where(~held_out(F.col("id")) & F.col("body").isNotNull() & F.col("lang").isNotNull())
    first = F.row_number().over(Window.partitionBy("lang").orderBy(F.length("body") > usual_chars, F.xxhash64("id"), "id", "body"))
    found = rows.withColumn("rank", first).where(F.col("rank") <= rows_per_language).select("lang", "rank", "body").collect()
    out: dict[str, str] = {}
    for r in sorted(found, key=lambda r: (r.lang, r["rank"])):
        out[r.lang] = out.get(r.lang, "") + r.body + "\n"
    return {k: v for k, v in out.items() if any(c.isalpha() for c in v)}


_built: dict[int, CrossParser] = {}


def identify(docs: DataFrame, samples: dict[str, str], *, text: str = "text", chunk_chars: int = 16 << 20) -> Column:
    """Column ``struct<lang: string, score: double>``: the language of each whole text and how far it is ahead.

    ``score`` is 1 less the winner's phrases over those of the next language (1 if there is but one), between 0
    and 1; ties go to the language first by name. Null and empty texts, texts without a letter, and all texts where
    there is no sample (an empty table gives none), give ``und`` and 0. Repeated rows get the same. Very long texts are parsed whole; texts go
    together up to ``chunk_chars`` characters times languages. The column may stand beside any others.
    """
    key = hash(tuple(sorted(samples.items())))

    @F.pandas_udf("lang string, score double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        if key not in _built:
            _built.clear()
            _built[key] = CrossParser(samples)
        parser = _built[key]

        def judged(texts: list[str]) -> list[tuple[str, float]]:
            rates, letters = parser.parse(texts)
            if not parser.languages:
                return [("und", 0.0)] * len(texts)
            best = rates.argmin(axis=1)
            least = rates.min(axis=1)
            rates[np.arange(len(texts)), best] = np.inf
            ahead = 1 - least / rates.min(axis=1) if len(parser.languages) > 1 else np.ones(len(texts))
            return [(parser.languages[b], float(a)) if has else ("und", 0.0) for b, a, has in zip(best, ahead, letters, strict=True)]

        for batch in batches:
            out, some, size = [], [], 0
            for t in batch:
                some.append(t or "")
                size += len(some[-1])
                if size * max(1, len(samples)) > chunk_chars:
                    out += judged(some)
                    some, size = [], 0
            out += judged(some)
            yield pd.DataFrame(out, columns=["lang", "score"])

    return run(docs[text])
