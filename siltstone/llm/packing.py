"""Operator 8: cost-balanced packing of documents into fixed-length training sequences.

A piece of n tokens costs ``linear * n + quadratic * n * n`` (feed-forward and attention work). Within a block
of a few million tokens, pieces go in descending cost to the sequence of lowest cost that still has room for
them; a piece that no sequence has room for is cut. Blocks are packed where their documents are tokenised, so
nothing is shuffled and memory is bounded by the block, whatever the input holds.
"""

from __future__ import annotations

import heapq
import json
import re
import sys
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Sequences of one task are numbered from its partition number times this.
_PER_TASK = 1 << 33


#: Runs of printable ASCII and Latin-1 letters: normalising them is lower-casing, and the splitting below holds.
_PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
_PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")


def _packed(ids: Iterable[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class PieceIds(dict):
    """Token ids (little-endian unsigned 32-bit) of runs without ASCII white space, at most ``limit`` runs.

    A run that is new goes through the tokenizer; runs of plain characters are split here by the tokenizer's
    own rule and only their parts go through its model, which is several times faster and gives the same ids.
    Other tokenizers, whose rule is not known to be that one, get every run whole.
    """

    def __init__(self, tokenizer_json: str, limit: int):
        from tokenizers import Tokenizer, pre_tokenizers

        super().__init__()
        self.tokenizer, self.limit, self.parts = Tokenizer.from_str(tokenizer_json), limit, {}
        self.tokenize = self.tokenizer.model.tokenize
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.bytes_as = {ord(c): level.pre_tokenize_str(c)[0][0] for c in map(chr, range(0xC0, 0x100))}
        self.special = [t["content"].lower() for t in json.loads(tokenizer_json).get("added_tokens", [])]
        marked = all("<" in x for x in self.special)
        probe = "it's l'été 42!? naïve-straße's 'll x''s a1b2 <|x|> ÀÉ"
        self.plain = marked and all(self._split(w) == self._whole(w) for w in probe.split())
        spaced = f" {probe}\n\n{probe}\t  x"
        self.by_runs = self._whole(spaced) == b"".join(self._whole(w) for w in spaced.split())

    def of(self, text: str) -> bytes:
        """Ids of a whole text: run by run if the tokenizer passes over white space, else as it is."""
        return b"".join(map(self.__getitem__, text.encode().split())) if self.by_runs else self._whole(text)

    def _whole(self, run: str) -> bytes:
        return _packed(self.tokenizer.encode(run, add_special_tokens=False).ids)

    def _part(self, part: str) -> bytes:
        if len(self.parts) >= self.limit:
            self.parts.clear()
        known = part if part.isascii() else part.translate(self.bytes_as)
        ids = self.parts[part] = _packed(t.id for t in self.tokenize(known))
        return ids

    def _split(self, run: str) -> bytes:
        parts, low = self.parts, run.lower()
        if run.isalpha():
            return parts.get(low) or self._part(low)
        return b"".join([parts.get(p) or self._part(p) for p in _PARTS.findall(low)])

    def __missing__(self, run: bytes) -> bytes:
        word = run.decode()
        plain = self.plain and len(word) <= 256 and _PLAIN.fullmatch(word) and not (b"<" in run and any(x in word.lower() for x in self.special))
        ids = self._split(word) if plain else self._whole(word)
        if len(run) <= 64:
            if len(self) >= self.limit:
                self.clear()
            self[run] = ids
        return ids


def assign(lengths: np.ndarray, capacity: int, linear: float, quadratic: float) -> list[list[tuple[int, int, int]]]:
    """Sequences as lists of (piece, start within it, length); every token lies in exactly one.

    All sequences but the last few are full: as many as the tokens fill, then powers of two for the remainder.
    """
    total = int(lengths.sum())
    full = total // capacity
    bins: list[list[tuple[int, int, int]]] = [[] for _ in range(full)]
    room = np.full(full, capacity, dtype=np.int64)
    cost = np.zeros(full)
    heap = [(-int(n), i, 0) for i, n in enumerate(lengths) if n]
    heapq.heapify(heap)
    tail: list[tuple[int, int, int]] = []
    while heap:
        minus, piece, start = heapq.heappop(heap)
        n = -minus
        fits = np.where(room >= n, cost, np.inf)
        at = int(fits.argmin()) if full else 0
        if not full or fits[at] == np.inf:  # cut: the emptiest sequence takes what it can
            at = int(room.argmax()) if full else 0
            take = int(room[at]) if full else 0
            if not take:
                tail.append((piece, start, n))
                continue
            heapq.heappush(heap, (take - n, piece, start + take))
            n = take
        bins[at].append((piece, start, n))
        room[at] -= n
        cost[at] += linear * n + quadratic * n * n
    left = sum(n for _, _, n in tail)
    while left:
        size, left_in = 1 << (left.bit_length() - 1), 1 << (left.bit_length() - 1)
        left -= size
        bins.append([])
        while left_in:
            piece, start, n = tail.pop()
            take = min(n, left_in)
            bins[-1].append((piece, start, take))
            if n > take:
                tail.append((piece, start + take, n - take))
            left_in -= take
    return bins


_built: dict[int, PieceIds] = {}


def pack(
    docs: DataFrame,
    tokenizer_json: str,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    capacity: int = 4096,
    end_id: int = 2,
    linear: float = 1.0,
    quadratic: float = 1 / 4096,
    block_tokens: int = 4 << 20,
    cache_runs: int = 1_000_000,
) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids`` (little-endian unsigned 32-bit), ``doc_tokens,
    sequence_id, offset``.

    A document is the tokenizer's ids of its whole text (null: empty) and then ``end_id``, so empty texts
    still give one token. Documents above ``capacity`` fill sequences of their own first. Sequences hold
    ``capacity`` tokens but for those of a block's remainder, which hold powers of two. Runs between ASCII
    white space are tokenised one by one and remembered where a probe shows that the tokenizer passes over white
    space; texts go to other tokenizers whole. A very long text is tokenised in one task. Rows that share an id are packed each; other columns are ignored. An empty table gives no rows.
    """
    held = docs.sparkSession.sparkContext.broadcast(tokenizer_json)
    key = hash(tokenizer_json)
    id_type = pa.int64()
    end = np.asarray([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _built:
            _built.clear()
            _built[key] = PieceIds(held.value, cache_runs)
        ids_of = _built[key].of
        number = TaskContext.get().partitionId() * _PER_TASK
        names: list = []
        ids: list[bytes] = []
        waiting = 0

        def packed() -> Iterator[pa.RecordBatch]:
            nonlocal number, waiting
            rows: dict[str, list] = {k: [] for k in ("doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset")}
            size = 0

            def put(i: int, start: int, n: int, sequence: int, offset: int) -> None:
                nonlocal size
                part = ids[i][4 * start : 4 * (start + n)]
                size += len(part)
                for k, v in zip(rows, (names[i], start, n, part, len(ids[i]) // 4, sequence, offset), strict=True):
                    rows[k].append(v)

            rest = np.zeros(len(ids), dtype=np.int64)
            for i, own in enumerate(ids):
                n = len(own) // 4
                for s in range(0, n - n % capacity, capacity):
                    put(i, s, capacity, number, 0)
                    number += 1
                rest[i] = n % capacity
            for sequence in assign(rest, capacity, linear, quadratic):
                offset = 0
                for i, start, n in sequence:
                    put(i, len(ids[i]) // 4 - int(rest[i]) + start, n, number, offset)
                    offset += n
                number += 1
                if size > 8 << 20:
                    yield _batch(rows, id_type)
                    rows, size = {k: [] for k in rows}, 0
            yield _batch(rows, id_type)
            names.clear()
            ids.clear()
            waiting = 0

        for batch in batches:
            for name, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                body = ids_of(t.as_py() or "") + end
                names.append(name)
                ids.append(body)
                waiting += len(body) // 4
                if waiting >= block_tokens:
                    yield from packed()
        if ids:
            yield from packed()

    schema = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


def _batch(rows: dict[str, list], id_type: pa.DataType) -> pa.RecordBatch:
    kinds = {"ids": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(v, kinds.get(k, id_type)) for k, v in rows.items()], names=list(rows))
