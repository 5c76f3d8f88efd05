"""Operator 2: SimHash near-duplicates with pigeonring pruning.

Fingerprints are taken in Arrow batches. Candidates share whole segments of the fingerprint; within a bucket a
pair must first show a chain of consecutive segments whose summed differences stay within the chain's share of
the distance, and only then is the full distance counted. Buckets give spanning edges, never all their pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import Scratch
from siltstone.llm.graph import components

_U = np.uint64
#: The constants of XXH64 (public specification).
_P1, _P2, _P3, _P4, _P5 = (_U(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << _U(r)) | (x >> _U(64 - r))


def _lane(x: np.ndarray) -> np.ndarray:
    return _rotl(x * _P2, 31) * _P1


def xxh64_same_length(buffer: np.ndarray, starts: np.ndarray, n: int, seed: int) -> np.ndarray:
    """XXH64 of ``buffer[s : s + n]`` for every start; ``buffer`` has 8 spare bytes at its end."""
    eight = np.ndarray((len(buffer) - 7,), dtype="<u8", buffer=buffer, strides=(1,))
    with np.errstate(over="ignore"):
        s, at = _U(seed), 0
        if n >= 32:
            v = [np.full(len(starts), x, dtype=_U) for x in (s + _P1 + _P2, s + _P2, s, s - _P1)]
            while at + 32 <= n:
                v = [_rotl(x + eight[starts + at + 8 * k] * _P2, 31) * _P1 for k, x in enumerate(v)]
                at += 32
            acc = _rotl(v[0], 1) + _rotl(v[1], 7) + _rotl(v[2], 12) + _rotl(v[3], 18)
            for x in v:
                acc = (acc ^ _lane(x)) * _P1 + _P4
        else:
            acc = np.full(len(starts), s + _P5, dtype=_U)
        acc = acc + _U(n)
        while at + 8 <= n:
            acc = _rotl(acc ^ _lane(eight[starts + at]), 27) * _P1 + _P4
            at += 8
        if at + 4 <= n:
            acc = _rotl(acc ^ ((eight[starts + at] & _U(0xFFFFFFFF)) * _P1), 23) * _P2 + _P3
            at += 4
        for k in range(at, n):
            acc = _rotl(acc ^ (buffer[starts + k].astype(_U) * _P5), 11) * _P1
        acc = (acc ^ (acc >> _U(33))) * _P2
        acc = (acc ^ (acc >> _U(29))) * _P3
        return acc ^ (acc >> _U(32))


def fingerprints(texts: list[bytes], width: int = 4, seed: int = 42) -> np.ndarray:
    """64-bit SimHash of each text over its ``width``-word shingles, repeats included."""
    joined = [b" ".join(t.lower().split()) for t in texts]
    buffer = np.frombuffer(b"\n".join(joined) + b"\n" + bytes(8), dtype=np.uint8)
    gaps = np.flatnonzero((buffer[:-8] == 32) | (buffer[:-8] == 10))
    first = np.concatenate(([0], gaps[:-1] + 1))  # of each word; a text without words has one empty word
    text_of = np.repeat(np.arange(len(texts)), np.diff(np.flatnonzero(buffer[gaps] == 10), prepend=-1))
    whole = np.flatnonzero(text_of[width - 1 :] == text_of[: len(text_of) - width + 1]) if len(text_of) >= width else np.zeros(0, np.int64)
    starts, sizes, owner = first[whole], gaps[whole + width - 1] - first[whole], text_of[whole]
    hashes = np.zeros(len(whole), dtype=_U)
    order = np.argsort(sizes, kind="stable")
    edges = np.flatnonzero(np.diff(sizes[order], prepend=-1, append=-1))
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        rows, n = order[a:b], int(sizes[order[a]])
        if len(rows) < 8 or n > 512:
            hashes[rows] = [xxhash.xxh64_intdigest(buffer[s : s + n].tobytes(), seed) for s in starts[rows]]
        else:
            hashes[rows] = xxh64_same_length(buffer, starts[rows], n, seed)
    out = np.zeros(len(texts), dtype=_U)
    shingles = np.bincount(owner, minlength=len(texts))
    for i in np.flatnonzero(shingles == 0):
        if joined[i]:
            out[i] = xxhash.xxh64_intdigest(joined[i], seed)
    if not len(whole):
        return out
    # Eight counters of a byte each lie in one integer, for up to 255 hashes at a time.
    begin = np.flatnonzero(np.diff(owner, prepend=-1))
    within = np.arange(len(owner)) - np.repeat(begin, np.diff(np.append(begin, len(owner))))
    part = np.flatnonzero(within % 255 == 0)
    part_begin = np.flatnonzero(np.diff(owner[part], prepend=-1))
    some = owner[begin]
    for k in range(8):
        lanes = np.add.reduceat((hashes >> _U(k)) & _U(0x0101010101010101), part).view(np.uint8).reshape(-1, 8)
        counts = np.add.reduceat(lanes, part_begin, axis=0, dtype=np.int64)
        for byte in range(8):
            out[some] |= (2 * counts[:, byte] > shingles[some]).astype(_U) << _U(8 * byte + k)
    return out


def chain_viable(x: np.ndarray, distance: int, segments: int = 8, chain: int = 3) -> np.ndarray:
    """Pigeonring: some start on the ring of segments has every prefix of its chain within its share."""
    ones = np.bitwise_count(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), 8)).astype(np.int16)
    ok, total = np.ones_like(ones, dtype=bool), np.zeros_like(ones)
    for k in range(chain):
        total = total + np.roll(ones, -k, axis=1)
        ok &= total <= distance * (k + 1) // segments
    return ok.any(axis=1)


def _near(x: np.ndarray, distance: int) -> np.ndarray:
    rows = np.flatnonzero(chain_viable(x, distance))
    return rows[np.bitwise_count(x[rows]) <= distance]


def bucket_edges(prints: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the bucket's links."""
    edges, rest = [], prints
    while len(rest):
        frontier, rest = [rest[0]], rest[1:]
        while frontier and len(rest):
            at = frontier.pop()
            near = _near(rest ^ at, distance)
            if len(near):
                edges += [(int(at), int(b)) for b in rest[near]]
                frontier.extend(rest[near])
                rest = np.delete(rest, near)
    return edges


def dense_edges(prints: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """As ``bucket_edges``, for many fingerprints that differ in few bits: all values of these bits are laid out, and
    the least label within the distance spreads from value to value, in time that doesn't depend on how many link."""
    differ = np.bitwise_or.reduce(prints ^ prints[0])
    bits = [b for b in range(64) if differ >> _U(b) & _U(1)]
    place = np.zeros(len(prints), np.int64)
    for j, b in enumerate(bits):
        place |= ((prints >> _U(b) & _U(1)) << _U(j)).astype(np.int64)
    none = len(prints)
    label = np.arange(none, dtype=np.int32)
    while True:
        grid = np.full(1 << len(bits), none, dtype=np.int32)
        grid[place] = label
        for _ in range(distance):
            last = grid
            grid = last.copy()
            for j in range(len(bits)):
                np.minimum(grid.reshape(-1, 2, 1 << j), last.reshape(-1, 2, 1 << j)[:, ::-1], out=grid.reshape(-1, 2, 1 << j))
        new = grid[place]
        new = np.minimum(new, new[new])
        if (new == label).all():
            return [(int(prints[a]), int(p)) for a, p in zip(label, prints, strict=True) if prints[a] != p]
        label = new


#: (segments, of which whole ones that a link must share): a pair at 4 bits leaves all but 4 segments alone. Keys get
#: longer from left to right; buckets of the last hold at most 2^24 fingerprints.
_LEVELS = ((6, 2), (7, 3), (8, 4), (12, 8))


def _first_level(n: int) -> int:
    return 0 if n <= 1 << 22 else 1 if n <= 1 << 28 else 2


def _keys(fps: np.ndarray, count: int, whole: int) -> np.ndarray:
    """The keys of each fingerprint, one row for each choice of segments."""
    cuts = [round(64 * k / count) for k in range(count + 1)]
    width = [b - a for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    part = [fps >> _U(cuts[k]) & _U((1 << width[k]) - 1) for k in range(count)]
    out = []
    for number, chosen in enumerate(combinations(range(count), whole)):
        key = np.full(len(fps), number, dtype=_U)
        for k in chosen:
            key = key << _U(width[k]) | part[k]
        out.append(key)
    return np.stack(out)


def _level_links(prints: DataFrame, level: int, bucket_limit: int | None) -> DataFrame:
    """Edges ``(a, b)`` between fingerprints that share a key of the level; those of buckets above ``bucket_limit``
    come as ``(fp, fp)``."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy()
            for s in range(0, len(fps), 1024):
                keys = _keys(fps[s : s + 1024].view(_U), *_LEVELS[level])
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(np.tile(fps[s : s + 1024], len(keys)))], names=["key", "fp"])

    keyed = prints.mapInArrow(spread, "key long, fp long").repartition("key").sortWithinPartitions("key", "fp")

    def closed(keys: np.ndarray, fps: np.ndarray) -> list[tuple[int, int]]:
        """Edges of whole buckets."""
        at = np.flatnonzero(np.diff(keys)) + 1
        at = np.concatenate(([0], at, [len(keys)])) if len(keys) else np.zeros(1, np.int64)
        size = np.diff(at)
        two = at[:-1][size == 2]
        two = two[_near(fps[two] ^ fps[two + 1], 4)] if len(two) else two
        out = [(int(a), int(b)) for a, b in zip(fps[two], fps[two + 1], strict=True)]
        for i in np.flatnonzero(size > 2):
            own = fps[at[i] : at[i + 1]]
            if bucket_limit is not None and len(own) > bucket_limit:
                out += [(int(f), int(f)) for f in own]
            else:
                out += bucket_edges(own, 4) if len(own) <= _DENSE else dense_edges(own, 4)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps, crowded = np.zeros(0, np.int64), np.zeros(0, _U), None
        for batch in batches:
            keys = np.concatenate((keys, batch.column(0).to_numpy()))
            fps = np.concatenate((fps, batch.column(1).to_numpy().view(_U)))
            if crowded is not None:
                n = int(np.searchsorted(keys, crowded, side="right"))
                yield _edge_batch([(int(f), int(f)) for f in fps[:n]])
                keys, fps = keys[n:], fps[n:]
            if not len(keys):
                continue
            crowded = None
            last = int(np.searchsorted(keys, keys[-1]))  # the last bucket may go on in the next batch
            yield _edge_batch(closed(keys[:last], fps[:last]))
            keys, fps = keys[last:], fps[last:]
            if bucket_limit is not None and len(keys) > bucket_limit:
                crowded = int(keys[-1])
                yield _edge_batch([(int(f), int(f)) for f in fps])
                keys, fps = keys[:0], fps[:0]
        yield _edge_batch(closed(keys, fps))

    return keyed.mapInArrow(run, "a long, b long").distinct()


#: Buckets of more fingerprints than this are laid out by their bits.
_DENSE = 4096


def links(scratch: Scratch, prints: DataFrame, bucket_limit: int = 4096) -> DataFrame:
    """Edges ``(a, b)`` between distinct fingerprints ``fp`` at 4 or fewer bits, enough to join whatever links.

    Fingerprints of buckets above ``bucket_limit`` meet again by longer keys, of which a link must share one, too;
    the buckets of the longest keys hold at most 2^24.
    """
    edges, level = None, _first_level(prints.count())
    while True:
        last = level == len(_LEVELS) - 1
        found = scratch.keep(_level_links(prints, level, None if last else bucket_limit))
        own = found.where("a <> b")
        edges = own if edges is None else edges.unionAll(own)
        crowded = found.where("a = b").select(F.col("a").alias("fp"))
        if last or crowded.isEmpty():
            return edges
        prints, level = crowded, max(2, level + 1)


def _edge_batch(edges: list[tuple[int, int]]) -> pa.RecordBatch:
    two = np.array(edges, dtype=_U).reshape(-1, 2).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(two[:, 0]), pa.array(two[:, 1])], names=["a", "b"])


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", bucket_limit: int = 4096) -> DataFrame:
    """``doc_id, fp, component_id`` for every row of ``docs``; other columns are ignored.

    ``fp`` is the SimHash as a signed 64-bit integer; a text without words (null, empty, blank) has 0 and links
    like any other. ``component_id`` is the least ``doc_id`` that links of at most 4 bits reach (null
    ids are passed over; null if there is no other). Rows that share an id, or are wholly equal, are kept each. A
    text is hashed whole in one task, however long. An empty table gives none.

    Every join is between two written tables, so that a fingerprint or component of very many documents is split.
    """
    scratch = Scratch(docs.sparkSession, "simhash")

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, out, some, size = batch.column(1), [], [], 0
            for t in column:
                some.append((t.as_py() or "").encode())
                size += len(some[-1])
                if size > 2 << 20:
                    out.append(fingerprints(some))
                    some, size = [], 0
            out.append(fingerprints(some) if some else np.zeros(0, _U))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(out).view(np.int64))], names=["doc_id", "fp"])

    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    each = scratch.keep(own.mapInArrow(prints, "doc_id long, fp long"))
    distinct = scratch.keep(each.groupBy("fp").agg(F.min("doc_id").alias("least_id")))
    joined = scratch.keep(components(scratch, links(scratch, distinct.select("fp"), bucket_limit)))
    members = scratch.keep(distinct.join(joined, distinct["fp"] == joined["node"]).select("root", F.col("fp").alias("member"), "least_id"))
    roots = scratch.keep(members.groupBy("root").agg(F.min("least_id").alias("component_id")).withColumnRenamed("root", "of"))
    linked = scratch.keep(members.join(roots, F.col("root") == F.col("of")).select("member", "component_id"))
    per_print = distinct.join(linked, distinct["fp"] == linked["member"], "left").select(F.col("fp").alias("key"), F.coalesce("component_id", "least_id").alias("component_id"))
    per_print = scratch.keep(per_print)
    return each.join(per_print, each["fp"] == per_print["key"]).select("doc_id", "fp", "component_id")
