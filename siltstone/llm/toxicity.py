"""Operator 4: toxicity by a weighted lexicon, matched with Aho-Corasick over folded text.

Folding undoes disguises: compatibility forms and accents, letters of other scripts that look Latin, digits and
signs that stand for letters. Lexicon entries are words or word beginnings; phrases that hold an entry but are
found in harmless texts only are exceptions, whose span hides the entries inside it. The score is a logistic
function of the summed weights over a power of the length.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import held_out

#: Letters that look like Latin ones (Cyrillic, Greek, Armenian, Latin variants and small capitals),
#: and what digits and signs stand for.
_ALIKE = str.maketrans(
    "аеорсухіјѕԁһкмнтԛԝ" + "αγεηικνορτυχωσ" + "օսհցոզ" + "ıɑɡɩʋøłđħŧ" + "ᴀʙᴄᴅᴇɢʜɪᴊᴋʟᴍɴᴏᴘʀᴛᴜᴠᴡʏᴢ",
    "aeopcyxijsdhkmhtqw" + "ayenikvoptuxwo" + "ouhgnq" + "iagivoldht" + "abcdeghijklmnoprtuvwyz",
)
_STANDS_FOR = str.maketrans("013457@$!|", "oieastasil")
_SIGN = re.compile(r"[013457@$!|](?:(?<=[^\W\d_].)(?=[013457@$!|]*[^\W\d_])|(?<![\w@$!|].)(?=[013457@$!|]*[^\W\d_]))")
_GAP = re.compile(r"[\W\d_]+")


class _Folded(dict):
    """What a character folds to, worked out at its first use."""

    def __missing__(self, point: int) -> str:
        shape = unicodedata.normalize("NFKD", chr(point).replace("ß", "ss"))
        self[point] = out = "".join(c for c in shape if not unicodedata.combining(c)).translate(_ALIKE)
        return out


_folded = _Folded()


def fold(text: str | None) -> str:
    """The words of a text, folded, each with a space before it and the last with one behind."""
    low = (text or "").lower()
    if not low.isascii():
        low = low.translate(_folded)
    low = _SIGN.sub(lambda m: m[0].translate(_STANDS_FOR), low)
    return f" {_GAP.sub(' ', low).strip()} " if low else " "


@dataclass
class Lexicon:
    """``weights`` by entry: `` word `` is a whole word, `` beg`` the beginning of one."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: list[str] = field(default_factory=list)
    power: float = 0.75
    slope: float = 1.0
    intercept: float = -3.0

    def automaton(self):
        import ahocorasick

        found = ahocorasick.Automaton()
        for entry, weight in self.weights.items():
            found.add_word(entry, (len(entry), weight))
        for phrase in self.exceptions:
            found.add_word(phrase, (len(phrase), 0.0))
        if len(found):
            found.make_automaton()
        return found

    def burden(self, automaton, folded: str) -> float:
        """Weights of the words hit, each word's heaviest entry once, over the number of words to ``power``."""
        hits: dict[int, float] = {}
        hidden: list[tuple[int, int]] = []
        if len(automaton):
            for end, (n, weight) in automaton.iter(folded):
                start = end - n + 1
                if not weight:
                    hidden.append((start, end))
                elif weight > hits.get(start, 0.0):
                    hits[start] = weight
        if hidden:
            hidden.sort()
            reach = list(accumulate((b for _, b in hidden), max))  # a hit is hidden if a phrase before it reaches past it
            starts = [a for a, _ in hidden]
            hits = {s: w for s, w in hits.items() if not (k := bisect_right(starts, s)) or reach[k - 1] <= s}
        total = sum(hits.values())
        return total / max(1, folded.count(" ") - 1) ** self.power

    def score(self, burden: float) -> float:
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, self.intercept + self.slope * burden))))


def _entries(word: str, shortest: int = 4, longest: int = 8) -> Iterator[str]:
    yield f" {word} "
    for k in range(shortest, min(longest, len(word)) + 1):
        yield f" {word[:k]}"


def learn(texts: Iterable[str | None], labels: Iterable[int], *, prior: float | None = None, min_weight: float = 3.0, min_share: float = 0.01) -> Lexicon:
    """A lexicon from labelled texts: entries at least ``min_share`` of the toxic texts have, with a log ratio of
    document frequencies of ``min_weight`` or more. ``prior``: the share of toxic texts where the scores are used."""
    rows = [(fold(t).split(), int(y)) for t, y in zip(texts, labels, strict=True)]
    n_toxic = sum(y for _, y in rows)
    n_clean = len(rows) - n_toxic
    out = Lexicon()
    if not n_toxic or not n_clean:
        return out
    least = max(3, math.ceil(min_share * n_toxic))
    toxic = Counter(e for words, y in rows if y for e in {e for w in set(words) for e in _entries(w)})
    toxic = {e: n for e, n in toxic.items() if n >= least}  # clean texts are only asked about these
    clean = Counter(e for words, y in rows if not y for e in {e for w in set(words) for e in _entries(w) if e in toxic})
    weighed = ((e, math.log((a + 0.5) / (n_toxic + 1) / (clean[e] + 0.5) * (n_clean + 1))) for e, a in toxic.items())
    out.weights = {e: round(w, 4) for e, w in sorted(weighed) if w >= min_weight}
    found = {0: Counter(), 1: Counter()}
    listed = {w for w in {w for words, _ in rows for w in words} if any(e in out.weights for e in _entries(w))}
    for words, y in rows:
        for i, w in enumerate(words):
            if w in listed:
                found[y].update(f" {p} " for p in {" ".join(words[i - 1 : i + 1]) if i else "", " ".join(words[i : i + 2])} if " " in p)
    out.exceptions = sorted(p for p, n in found[0].items() if n >= 3 and not found[1][p])
    automaton = out.automaton()
    points = [(out.burden(automaton, f" {' '.join(words)} "), y) for words, y in rows]
    share = n_toxic / len(rows) if prior is None else min(max(prior, 1e-3), 1 - 1e-3)
    weight = {1: share / n_toxic * len(rows), 0: (1 - share) / n_clean * len(rows)}
    a, b = math.log(share / (1 - share)), 1.0
    for _ in range(60):  # Newton steps of a logistic regression with a slight pull of the slope to 0
        ga, gb, haa, hab, hbb = 0.0, -1e-2 * b, 1e-6, 0.0, 1e-2
        for x, y in points:
            p = 1 / (1 + math.exp(-max(-60.0, min(60.0, a + b * x))))
            c, v = weight[y] * (y - p), weight[y] * p * (1 - p)
            ga, gb, haa, hab, hbb = ga + c, gb + c * x, haa + v, hab + v * x, hbb + v * x * x
        det = haa * hbb - hab * hab
        if det <= 1e-12:
            break
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        a, b = a + max(-2.0, min(2.0, da)), b + max(-2.0, min(2.0, db))
        if abs(da) + abs(db) < 1e-6:
            break
    out.intercept, out.slope = a, max(b, 0.0)
    return out


def learn_from(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", toxic_rows: int = 1500, clean_rows: int = 3000) -> Lexicon:
    """A lexicon from labelled documents that are not held out.

    The only bound is on the sample it is fitted on: the ``toxic_rows`` and ``clean_rows`` labelled rows first in
    the order of a hash of their id. Null labels and null ids are left out; of several labels the largest counts.
    """
    own = labels.select(F.col(doc_id).cast("long").alias("id"), F.col(label).cast("int").alias("y")).where("id is not null and y is not null")
    own = own.where(~held_out(F.col("id"))).groupBy("id").agg(F.max(F.when(F.col("y") > 0, 1).otherwise(0)).alias("y"))
    share = own.agg(F.avg("y")).first()[0]
    if share is None:
        return Lexicon()
    sample = own.where("y = 1").orderBy(F.xxhash64("id"), "id").limit(toxic_rows).unionAll(own.where("y = 0").orderBy(F.xxhash64("id"), "id").limit(clean_rows))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).alias("body")).join(F.broadcast(sample), F.col("doc") == F.col("id")).select("id", "body", "y")
    found = sorted({(r.id, r.body or "", r.y) for r in rows.collect()})
    return learn([t for _, t, _ in found], [y for _, _, y in found], prior=share)


_built: dict[int, tuple] = {}


def toxicity(docs: DataFrame, lexicon: Lexicon, *, text: str = "text") -> Column:
    """Column with the score of ``text``, 0 to 1; null, empty and wordless texts have that of no hit.

    Texts are folded and matched whole, in time linear in their length; repeated rows score the same. An empty table
    gives no rows, and an empty lexicon the score of no hit. The column may stand beside any others.
    """
    key = hash((tuple(sorted(lexicon.weights.items())), tuple(lexicon.exceptions), lexicon.intercept, lexicon.slope))

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        if key not in _built:
            _built.clear()
            _built[key] = (lexicon.automaton(),)
        automaton = _built[key][0]
        for batch in batches:
            yield pd.Series([lexicon.score(lexicon.burden(automaton, fold(t))) for t in batch], dtype="float64")

    return score(docs[text])
