"""Operator 1: token counts by a linear longest-match automaton.

The vocabulary is a trie over bytes. Every node carries a failure link and the number of pieces that following
it completes, both worked out once, so that a word's greedy longest-match length comes from one pass over its
bytes without building any piece. Words start with a space, as in vocabularies whose word-initial pieces do.
"""

from __future__ import annotations

import base64
from collections import deque
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class LongestMatch:
    """Greedy longest-match lengths over a vocabulary of byte strings; single bytes are always in it."""

    def __init__(self, vocabulary: Iterable[bytes]):
        goto: dict[int, int] = {}
        depth_first: list[list[tuple[int, int]]] = [[]]
        is_token = [False]
        for token in [bytes([b]) for b in range(256)] + list(vocabulary):
            node = 0
            for byte in token:
                key = node << 8 | byte
                child = goto.get(key)
                if child is None:
                    child = goto[key] = len(is_token)
                    is_token.append(False)
                    depth_first.append([])
                    depth_first[node].append((byte, child))
                node = child
            if node:
                is_token[node] = True
        n = len(is_token)
        fail, popped, rest = [0] * n, [0] * n, [0] * n
        queue = deque(depth_first[0])
        for _, child in depth_first[0]:
            popped[child] = rest[child] = 1
        while queue:
            _, node = queue.popleft()
            for byte, child in depth_first[node]:
                if is_token[child]:
                    fail[child], popped[child] = 0, 1
                else:
                    at, count = fail[node], popped[node]
                    while (onward := goto.get(at << 8 | byte)) is None:
                        count += popped[at]
                        at = fail[at]
                    fail[child], popped[child] = onward, count
                rest[child] = popped[child] + rest[fail[child]]
                queue.append((byte, child))
        self.goto, self.fail, self.popped, self.rest = goto, fail, popped, rest

    def length(self, word: bytes) -> int:
        goto, fail, popped, node, count = self.goto, self.fail, self.popped, 0, 0
        for byte in word:
            while (onward := goto.get(node << 8 | byte)) is None:
                count += popped[node]
                node = fail[node]
            node = onward
        return count + self.rest[node]


class WordLengths(dict):
    """Lengths of the words seen so far, at most ``limit`` of them; a full cache starts anew."""

    def __init__(self, automaton: LongestMatch, limit: int):
        super().__init__()
        self.automaton, self.limit = automaton, limit

    def __missing__(self, word: bytes) -> int:
        n = self.automaton.length(b" " + word)
        if len(word) <= 64:
            if len(self) >= self.limit:
                self.clear()
            self[word] = n
        return n


_built: dict[int, WordLengths] = {}


def count_tokens(docs: DataFrame, ranks: str, *, text: str = "text", into: tuple[str, str] = ("n_words", "n_tokens"), cache_words: int = 400_000) -> DataFrame:
    """``docs`` with the number of words and of greedy longest-match pieces of each whole text.

    ``ranks`` is the vocabulary as lines of base64 token and rank. Null, empty and blank texts count 0 and 0;
    rows are counted one by one, so ties and repeated rows need no rule. Columns already named as ``into`` are
    replaced, all others pass through. The vocabulary goes out by broadcast: its size does not depend on the data.
    """
    held = docs.sparkSession.sparkContext.broadcast(ranks)
    key = hash(ranks)

    @F.pandas_udf("words long, tokens long")
    def lengths(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        if key not in _built:
            _built.clear()
            _built[key] = WordLengths(LongestMatch(base64.b64decode(line.split()[0]) for line in held.value.splitlines() if line.strip()), cache_words)
        count = _built[key].__getitem__
        for batch in batches:
            rows = []
            for t in batch:
                words = t.encode().split() if t else ()
                rows.append((len(words), sum(map(count, words))))
            yield pd.DataFrame(rows, columns=["words", "tokens"])

    both = "__siltstone_token_counts"
    out = docs.withColumn(both, lengths(F.col(text)))
    return out.withColumns({into[0]: F.col(f"{both}.words"), into[1]: F.col(f"{both}.tokens")}).drop(both)
