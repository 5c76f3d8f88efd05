"""Operator 10: fuzzy line deduplication by MinHash.

Lines are lower-cased and trimmed. Each distinct line gets a one-permutation MinHash over its character
shingles, cut into bands; lines that share a band are compared by the exact Jaccard similarity of their shingle
sets, linked lines are joined across the cluster, and of each component one line stays, the first by document
and place.

A line is known by 128 bits of its hash, ``h`` and ``g``. Candidates are gathered by ``h`` alone; what is compared
and joined goes by both.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import Scratch
from siltstone.llm.graph import components

_U = np.uint64
_SHINGLE = 8
BANDS, ROWS = 12, 5
_SLOTS = BANDS * ROWS
#: Lines of fewer shingles have their smallest shingle hashes as keys, of which two similar ones share one.
_FEW = 24
_TRIM = " \t\x0b\x0c\r"
#: Counters of shingles by which the keys of crowded lines are chosen.
_CELLS = 1 << 20
_EMPTY = 0xFFFFFFFF
#: Characters that are hashed at a time.
_STEP = 1 << 18
#: Lines of a group up to which each is compared with each.
_PAIRWISE = 24
#: Lines of a group beyond which it is compared apart from those with the same least line.
_APART = 200
#: A key of a line as it is shuffled, and how many of them a task gathers before it lets crowded ones go.
_MET = np.dtype([("key", "<i8"), ("h", "<i8"), ("chars", "<i4")])
_HELD = 4_000_000


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (multiply and shift)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> _U(29))) * _U(0xC4CEB9FE1A85EC53)
        return x ^ (x >> _U(32))


def _windows(lines: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The shingle at each character of the lines end to end, the lines' ends, and where a shingle leaves its line.

    A shingle is the integer of its 8 characters where they fit in a byte each; others enter as 64 scrambled bits.
    """
    text, ends = "".join(lines), np.cumsum([len(t) for t in lines], dtype=np.int64)
    over = (ends[:, None] - np.arange(1, _SHINGLE)).ravel()
    try:
        raw = np.frombuffer(text.encode("latin-1") + bytes(_SHINGLE), dtype=np.uint8)
        return np.ndarray((len(text),), dtype="<u8", buffer=raw, strides=(1,)), ends, over
    except UnicodeEncodeError:
        code = np.frombuffer((text + "\0" * _SHINGLE).encode("utf-32-le"), dtype="<u4").astype(_U)
        wide = code > 255
        code[wide] = _mix(code[wide])
        out = code[: len(text)].copy()
        for k in range(1, _SHINGLE):
            out ^= (code[k : k + len(text)] << _U(8 * k)) | (code[k : k + len(text)] >> _U(64 - 8 * k))
        return out, ends, over


def _parts(lines: list[str]) -> Iterator[slice]:
    """Slices of the lines with few characters each, or a single line."""
    start, size = 0, 0
    for i, line in enumerate(lines):
        if size and (size + len(line) > _STEP or i - start >= 256):
            yield slice(start, i)
            start, size = i, 0
        size += len(line)
    if len(lines) > start:
        yield slice(start, len(lines))


def _least_common(size: np.ndarray, similarity: float) -> np.ndarray:
    """Shingles that a set of this size shares at least with a similar one."""
    return np.ceil(similarity * size - 1e-9).astype(np.int64)


def band_keys(lines: list[str]) -> np.ndarray:
    """Band keys, one row for each line; lines have 8 characters or more."""
    windows, ends, over = _windows(lines)
    begin = ends - np.diff(ends, prepend=0)
    sketch = np.full(len(lines) * _SLOTS + 1, _EMPTY, dtype=np.uint32)
    for s in range(0, len(windows), _STEP):
        e = min(len(windows), s + _STEP)
        first, last = np.searchsorted(ends, [s, e - 1], side="right")
        own = np.arange(first, last + 1)
        place = np.repeat(own * _SLOTS, np.minimum(ends[own], e) - np.maximum(begin[own], s))
        with np.errstate(over="ignore"):
            hashed = windows[s:e] * _U(0x9E3779B97F4A7C15)
            hashed ^= hashed >> _U(32)
            hashed *= _U(0xD6E8FEB86659FD93)
        high = hashed >> _U(32)
        value = (hashed ^ high).astype(np.uint32)
        high *= _U(_SLOTS)
        high >>= _U(32)
        place += high.view(np.int64)
        place[over[(over >= s) & (over < e)] - s] = len(lines) * _SLOTS
        np.minimum.at(sketch, place, value)
    sketch = sketch[:-1].reshape(-1, _SLOTS)
    # An empty slot takes the next filled one's value, marked with how far away it is.
    at = np.where(sketch != _EMPTY, np.arange(_SLOTS), 4 * _SLOTS)
    filled = np.minimum.accumulate(np.hstack((at, at + _SLOTS))[:, ::-1], axis=1)[:, ::-1][:, :_SLOTS]
    away = (filled - np.arange(_SLOTS)).astype(_U)
    values = np.take_along_axis(sketch, filled % _SLOTS, axis=1).astype(_U) + (away << _U(32))
    keys = np.broadcast_to(np.arange(BANDS, dtype=_U), (len(lines), BANDS)).copy()
    for r in range(ROWS):
        with np.errstate(over="ignore"):
            keys = _mix(keys * _U(31) + values[:, r::ROWS])
    return keys.view(np.int64)


def prefix_keys(lines: list[str], similarity: float, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Keys end to end, and each line's number of them: the first of a line's shingle set in an order that is the
    same for all lines, as many as leave out one less than what similar sets share. Two similar lines share a key,
    whatever the order; by ``counts`` of their cells, rare shingles come first."""
    windows, ends, over = _windows(lines)
    inside = np.ones(len(windows), dtype=bool)
    inside[over] = False
    owner = np.repeat(np.arange(len(lines)), np.diff(ends, prepend=0))[inside]
    hashed = _mix(windows[inside] + _U(1))
    common = np.zeros(len(hashed), np.int64) if counts is None else counts[(hashed >> _U(44)).astype(np.int64)]
    order = np.lexsort((hashed, common, owner))
    owner, hashed = owner[order], hashed[order]
    first = np.ones(len(owner), dtype=bool)
    first[1:] = (owner[1:] != owner[:-1]) | (hashed[1:] != hashed[:-1])
    owner, hashed = owner[first], hashed[first]
    size = np.bincount(owner, minlength=len(lines))
    take = size - _least_common(size, similarity) + 1
    rank = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
    return hashed[rank < take[owner]].view(np.int64), np.minimum(take, size)


def cell_counts(lines: list[str]) -> np.ndarray:
    windows, _, over = _windows(lines)
    inside = np.ones(len(windows), dtype=bool)
    inside[over] = False
    return np.bincount((_mix(windows[inside] + _U(1)) >> _U(44)).astype(np.int64), minlength=_CELLS)


def _shingle_sets(lines: list[str]) -> list[set]:
    windows, ends, _ = _windows(lines)
    return [set(windows[e - len(t) : e - _SHINGLE + 1].tolist()) for t, e in zip(lines, ends.tolist(), strict=True)]


def _similar(a: int, b: int, common: int, similarity: float) -> bool:
    return common >= similarity * (a + b - common) - 1e-9


class _Group:
    """The shingle sets of a group's lines, rare shingles first, and an index of the first ones of each line, by
    which the lines that can be similar to a given one are found."""

    def __init__(self, lines: list[str], similarity: float):
        windows, ends, over = _windows(lines)
        inside = np.ones(len(windows), dtype=bool)
        inside[over] = False
        owner = np.repeat(np.arange(len(lines)), np.diff(ends, prepend=0))[inside]
        _, number = np.unique(windows[inside], return_inverse=True)
        often = np.bincount(number)
        self.kinds = len(often)
        rank = np.empty(self.kinds, dtype=np.int64)
        rank[np.argsort(often, kind="stable")] = np.arange(self.kinds)
        code = np.sort(owner * self.kinds + rank[number])  # np.unique would hash, which is slower here
        once = np.ones(len(code), dtype=bool)
        once[1:] = code[1:] != code[:-1]
        code = code[once]
        self.flat, owner = code % self.kinds, code // self.kinds
        self.size = np.bincount(owner, minlength=len(lines))
        self.begin = np.cumsum(self.size) - self.size
        self.first = self.size - _least_common(self.size, similarity) + 1
        early = (np.arange(len(owner)) - self.begin[owner]) < self.first[owner]
        kind, who = self.flat[early], owner[early]
        self.having = who[np.argsort(kind, kind="stable")]
        self.at = np.concatenate(([0], np.cumsum(np.bincount(kind, minlength=self.kinds))))
        self.similarity = similarity

    def near(self, i: int, eligible: np.ndarray) -> np.ndarray:
        """Lines among the eligible that are similar to line ``i``."""
        early = self.flat[self.begin[i] : self.begin[i] + self.first[i]]
        early = early[self.at[early + 1] - self.at[early] > 1]
        found = np.zeros(len(self.size), dtype=bool)
        for a, b in zip(self.at[early].tolist(), self.at[early + 1].tolist(), strict=True):
            found[self.having[a:b]] = True
        size = self.size
        rows = np.flatnonzero(found & eligible & (size >= self.similarity * size[i] - 1e-9) & (self.similarity * size <= size[i] + 1e-9))
        if not len(rows):
            return rows
        own = np.zeros(self.kinds, dtype=bool)
        own[self.flat[self.begin[i] : self.begin[i] + size[i]]] = True
        length = size[rows]
        start = np.cumsum(length) - length
        places = np.repeat(self.begin[rows] - start, length) + np.arange(int(length.sum()))
        common = np.add.reduceat(own[self.flat[places]].astype(np.int64), start)
        return rows[_similar_rows(size[i], length, common, self.similarity)]


def _similar_rows(a: int, b: np.ndarray, common: np.ndarray, similarity: float) -> np.ndarray:
    return common >= similarity * (a + b - common) - 1e-9


def _sorted_sets(lines: list[str]) -> list[np.ndarray]:
    """The shingles of each line, sorted, each once."""
    windows, ends, _ = _windows(lines)
    out = []
    for t, e in zip(lines, ends.tolist(), strict=True):
        own = np.sort(windows[e - len(t) : max(e - _SHINGLE + 1, e - len(t))])
        out.append(own[np.concatenate(([True], own[1:] != own[:-1]))] if len(own) else own)
    return out


def group_edges(lines: list[str], similarity: float, known: list[int] | None = None) -> list[tuple[int, int]]:
    """Edges (by place) that join whatever links among the lines: each line that nothing has reached yet is
    compared with all others, and then each line outside of the largest cluster with those of other clusters.
    Lines with the same number in ``known`` are joined already."""
    n = len(lines)
    if n <= _PAIRWISE:
        sets, edges, label = _sorted_sets(lines), [], list(known or range(n))
        for i in range(n):
            for j in range(i + 1, n):
                a, b = len(sets[i]), len(sets[j])
                if label[i] == label[j] or not _similar(a, b, min(a, b), similarity):
                    continue
                both = np.sort(np.concatenate((sets[i], sets[j])))
                if _similar(a, b, int(np.count_nonzero(both[1:] == both[:-1])), similarity):
                    edges.append((i, j))
                    label = [label[i] if x == label[j] else x for x in label]
        return edges
    group, edges, label = _Group(lines, similarity), [], np.array(known or range(n))
    reached, asked = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)

    def compare(i: int) -> None:
        near = group.near(i, label != label[i])
        asked[i] = True
        if len(near):
            clusters, one = np.unique(label[near], return_index=True)
            edges.extend((i, int(j)) for j in near[one])
            reached[near] = True
            label[np.isin(label, clusters)] = label[i]

    for i in range(n):
        if not reached[i]:
            compare(i)
    largest = np.bincount(label).argmax()
    for i in np.flatnonzero((label != largest) & ~asked).tolist():
        compare(i)
    return edges


def _arrow(kinds: dict[str, pa.DataType], columns: dict[str, list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[k], kind) for k, kind in kinds.items()], names=list(kinds))


def _bodies(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(doc_id).cast("long").alias("doc"), F.xxhash64(body).alias("text_hash"), body.alias("body"))


def _lines_of(body: str) -> list[str]:
    return [x.strip(_TRIM) for x in body.lower().split("\n")]


def _signed(bodies: DataFrame, min_chars: int, similarity: float, remember: int) -> DataFrame:
    """Each line's place and hashes; its size and keys with the first of equal lines that a task meets, as far as
    it remembers. Lines of under 8 characters have no keys: to be similar they have to be equal."""

    def keyed(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
        chars = np.array([len(t) for t in lines])
        long = np.flatnonzero(chars >= _SHINGLE + _FEW - 1)
        short = np.flatnonzero((chars >= _SHINGLE) & (chars < _SHINGLE + _FEW - 1))
        per = np.zeros(len(lines), np.int64)
        per[long] = BANDS
        values, number = prefix_keys([lines[i] for i in short], similarity) if len(short) else (np.zeros(0, np.int64), per[:0])
        per[short] = number
        owner = np.repeat(np.arange(len(lines)), per)
        keys = np.zeros(len(owner), np.int64)
        if len(long):
            keys[np.isin(owner, long)] = band_keys([lines[i] for i in long]).ravel()
        keys[np.isin(owner, short)] = values
        return keys, per

    def batch_of(rows: list[tuple], digests: list[bytes], fresh: list[tuple[int, str]]) -> pa.RecordBatch:
        per, chars, keys = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int32), []
        at = [i for i, _ in fresh]
        chars[at] = [len(t) for _, t in fresh]
        lines = [t for _, t in fresh]
        for part in _parts(lines):
            own, per[at[part]] = keyed(lines[part])
            keys.append(own)
        both = np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)
        doc, text_hash, place = zip(*rows, strict=True) if rows else ((), (), ())
        own = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(per))), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *keys])))
        columns = [pa.array(doc, pa.int64()), pa.array(text_hash, pa.int64()), pa.array(place, pa.int32()), pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy()), pa.array(chars), own]
        return pa.RecordBatch.from_arrays(columns, names=["doc", "text_hash", "at", "h", "g", "chars", "bands"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[bytes] = set()
        for batch in batches:
            rows, digests, fresh, size = [], [], [], 0
            for doc, text_hash, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                for at, line in enumerate(_lines_of(body.as_py())):
                    if not line or len(line) < min_chars:
                        continue
                    digest = xxhash.xxh3_128_digest(line.encode())
                    if digest not in met:
                        met.add(digest)
                        fresh.append((len(rows), line))
                        size += len(line)
                    rows.append((doc, text_hash, at))
                    digests.append(digest)
                if size > 4 << 20 or len(rows) > 50_000:
                    yield batch_of(rows, digests, fresh)
                    rows, digests, fresh, size = [], [], [], 0
                    if len(met) > remember:
                        met.clear()
            yield batch_of(rows, digests, fresh)

    return bodies.mapInArrow(run, "doc long, text_hash long, at int, h long, g long, chars int, bands array<bigint>")


def _met(rows: DataFrame, n_keys: int, crowd: int, crowd_chars: int) -> DataFrame:
    """``grp, least, h, chars, key`` of lines that share one of their keys, of ``rows (keys, h, chars)`` with about ``n_keys``
    keys in all. Groups with the same lines have the same ``grp``; ``least`` is the least ``h`` of the group, and ``grp`` itself
    for one of over ``_APART`` lines, so that large groups don't gather in a task. Rows of a key with over ``crowd`` lines or ``crowd_chars``
    characters have it as ``key``, and a few of them may come twice.

    Keys go to buckets, of which there are as many as keep them small, and are shuffled as packed values, a few for each
    task and bucket; a bucket is sorted in one piece. What it holds of crowded keys leaves it whenever it grows beyond
    ``_HELD`` keys, so that a key of any number of lines passes through.
    """
    buckets = max(256, n_keys // 250_000)
    kinds = {"grp": pa.int64(), "least": pa.int64(), "h": pa.int64(), "chars": pa.int32(), "key": pa.int64()}

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def packed() -> pa.RecordBatch:
            own = np.concatenate(held) if held else np.zeros(0, _MET)
            held.clear()
            bucket = ((own["key"].view(_U) >> _U(32)) * _U(buckets) >> _U(32)).astype(np.uint16 if buckets <= 1 << 16 else np.int32)
            own = own[np.argsort(bucket, kind="stable")]
            size = np.bincount(bucket, minlength=buckets)
            some = np.flatnonzero(size)
            ends = np.concatenate(([0], np.cumsum(size[some]) * _MET.itemsize)).astype(np.int32)
            data = pa.Array.from_buffers(pa.binary(), len(some), [None, pa.py_buffer(ends), pa.py_buffer(own.tobytes())])
            return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), data], names=["bucket", "data"])

        for batch in batches:
            keys = batch.column(0)
            per = keys.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            own = np.empty(int(per.sum()), _MET)
            own["key"], own["h"], own["chars"] = keys.flatten().to_numpy(), np.repeat(batch.column(1).to_numpy(), per), np.repeat(batch.column(2).to_numpy(), per)
            held.append(own)
            if sum(map(len, held)) > 1 << 20:
                yield packed()
        yield packed()

    def settle(own: np.ndarray, hot: set[int], last: bool) -> tuple[np.ndarray, pa.RecordBatch]:
        """What stays in the bucket, and the rows that leave it; the ``hot`` are keys known to be crowded."""
        keys = np.ascontiguousarray(own["key"])
        order = np.argsort(keys)
        keys = keys[order]
        same = keys[1:] == keys[:-1]
        several = np.concatenate((same, [False])) | np.concatenate(([False], same))
        if hot:
            several |= np.isin(keys, np.array(list(hot)))
        alone, own = own[order[~several]] if not last else own[:0], own[order[several]]
        own = own[np.lexsort((own["h"], own["key"]))]
        first = np.ones(len(own), dtype=bool)
        first[1:] = (own["key"][1:] != own["key"][:-1]) | (own["h"][1:] != own["h"][:-1])
        own = own[first]
        begin = np.flatnonzero(np.concatenate(([True], own["key"][1:] != own["key"][:-1]))) if len(own) else np.zeros(0, np.int64)
        size = np.diff(begin, append=len(own))
        total = np.add.reduceat(own["chars"].astype(np.int64), begin) if len(own) else size
        crowded = (size > crowd) | ((size > 1) & (total > crowd_chars))
        if hot:
            crowded |= np.isin(own["key"][begin], np.array(list(hot)))
        hot.update(own["key"][begin[crowded]].tolist())
        group = _mix(np.add.reduceat(_mix(own["h"].view(_U)), begin) + size.astype(_U)).view(np.int64) if len(own) else size
        of_crowded, grp = np.repeat(crowded, size), np.repeat(np.where(crowded, 0, group), size)
        leaves = of_crowded | (np.repeat(size > 1, size) if last else False)
        gone = own[leaves]
        columns = [grp[leaves], np.repeat(np.where(size > _APART, group, own["h"][begin]), size)[leaves], gone["h"], gone["chars"], pa.array(gone["key"], mask=~of_crowded[leaves])]
        out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.values(), strict=True)], names=list(kinds))
        return np.concatenate((alone, own[~leaves])), out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held, n, limit, hot = None, [], 0, _HELD, set()

        def leave(last: bool) -> Iterator[pa.RecordBatch]:
            rest, out = settle(np.concatenate(held), hot, last)
            held[:] = [] if last else [rest]
            for i in range(0, len(out), 1 << 16):
                yield out.slice(i, 1 << 16)

        for batch in batches:
            for this, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if this != bucket:
                    if held:
                        yield from leave(True)
                    bucket, n, limit, hot = this, 0, _HELD, set()
                held.append(np.frombuffer(data.as_py(), _MET))
                n += len(held[-1])
                if n > limit:
                    yield from leave(False)
                    n = len(held[0])
                    limit = max(_HELD, 2 * n)
        if held:
            yield from leave(True)

    packs = rows.select("keys", "h", "chars").mapInArrow(pack, "bucket int, data binary")
    return packs.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "grp long, least long, h long, chars int, key long")


def _texts(bodies: DataFrame, signed: DataFrame, wanted: DataFrame, broadcast_rows: int) -> DataFrame:
    """``h, g, line`` of the lines whose ``h`` is wanted, each once."""
    few = wanted.count() <= broadcast_rows
    own = signed.join(F.broadcast(wanted) if few else wanted, "h", "left_semi")
    first = own.groupBy("h", "g").agg(F.min(F.struct("doc", "text_hash", "at")).alias("p"))
    per_doc = first.groupBy(F.col("p.doc").alias("of"), F.col("p.text_hash").alias("of_hash")).agg(F.collect_list(F.struct(F.col("p.at").alias("at"), "h", "g")).alias("lines"))
    met = bodies.join(F.broadcast(per_doc) if few else per_doc, F.col("doc").eqNullSafe(F.col("of")) & (F.col("text_hash") == F.col("of_hash")))
    kinds = {"h": pa.int64(), "g": pa.int64(), "line": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {k: [] for k in kinds}
            size = 0
            for body, lines in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                own = _lines_of(body.as_py())
                for x in lines:
                    out["h"].append(x["h"])
                    out["g"].append(x["g"])
                    out["line"].append(own[x["at"]])
                    size += len(own[x["at"]])
                if size > 4 << 20:
                    yield _arrow(kinds, out)
                    out, size = {k: [] for k in kinds}, 0
            yield _arrow(kinds, out)

    return met.select("body", "lines").mapInArrow(run, "h long, g long, line string").dropDuplicates(["h", "g"])


def _prefixed(spark_rows: DataFrame, similarity: float) -> DataFrame:
    """``keys, h, chars`` of crowded lines ``(h, line)`` by their rarest shingles. How often shingles are is counted
    over all of these lines, in a table of counters of one size whatever the input."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_CELLS, np.int64)
        for batch in batches:
            lines = batch.column(1).to_pylist()
            for part in _parts(lines):
                total += cell_counts(lines[part])
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["cell", "n"])

    counts = np.zeros(_CELLS, np.int64)
    for r in spark_rows.select("h", "line").mapInArrow(count, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[r.cell] = r.n
    held = spark_rows.sparkSession.sparkContext.broadcast(counts)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hs, lines = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for part in _parts(lines):
                keys, per = prefix_keys(lines[part], similarity, held.value)
                own = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(per))), pa.int32()), pa.array(keys))
                yield pa.RecordBatch.from_arrays([own, pa.array(hs[part], pa.int64()), pa.array([len(t) for t in lines[part]], pa.int32())], names=["keys", "h", "chars"])

    return spark_rows.select("h", "line").mapInArrow(run, "keys array<bigint>, h long, chars int")


def _around_hubs(scratch: Scratch, crowded: DataFrame, texts: DataFrame, similarity: float, crowd: int, crowd_chars: int) -> tuple[DataFrame, DataFrame]:
    """Of keys that stay crowded: edges of their lines with the key's hub, the line of least hash, and groups
    ``(grp, least, h)`` of those that are not similar to it, in blocks, with all others of the hub, in blocks."""
    hubs = scratch.keep(crowded.groupBy("key").agg(F.min("h").alias("hub")).withColumnRenamed("key", "of"))
    members = scratch.keep(crowded.join(hubs, F.col("key") == F.col("of")).select("hub", "h", "chars").distinct())
    hub_texts = scratch.keep(texts.select(F.col("h").alias("hub_h"), F.col("g").alias("hub_g"), F.col("line").alias("hub_line")).join(hubs.select(F.col("hub").alias("is_hub")).distinct(), F.col("hub_h") == F.col("is_hub"), "left_semi"))
    rows = members.join(texts.withColumnRenamed("h", "text_of"), F.col("h") == F.col("text_of")).join(hub_texts, F.col("hub") == F.col("hub_h"))
    kinds = {"hub": pa.int64(), "h": pa.int64(), "chars": pa.int32(), "a": pa.binary(), "b": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: tuple = (None, set())
        for batch in batches:
            out: dict[str, list] = {k: [] for k in kinds}
            for hub, h, chars, node, line, hub_node, hub_line in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if known[0] != hub_node:
                    known = (hub_node, _shingle_sets([hub_line])[0])
                own = _shingle_sets([line])[0]
                near = _similar(len(own), len(known[1]), len(own & known[1]), similarity)
                for k, v in zip(kinds, (hub, h, chars, node if near else None, hub_node if near else None), strict=True):
                    out[k].append(v)
            yield _arrow(kinds, out)

    compared = rows.select("hub", "h", "chars", _node().alias("node"), "line", _node("hub_h", "hub_g").alias("hub_node"), "hub_line").mapInArrow(run, "hub long, h long, chars int, a binary, b binary")
    compared = scratch.keep(compared)
    far = F.col("a").isNull()
    blocks = lambda own: F.ceil(F.greatest(F.count_if(own) * 2.0 / crowd, F.sum(F.when(own, F.col("chars"))) * 2.0 / crowd_chars)).cast("long")
    sizes = scratch.keep(compared.groupBy("hub").agg(F.coalesce(blocks(far), F.lit(0)).alias("n_far"), F.coalesce(blocks(~far), F.lit(0)).alias("n_near")).where("n_far > 0").withColumnRenamed("hub", "of"))
    dealt = compared.join(sizes, F.col("hub") == F.col("of")).withColumn("spot", F.xxhash64("h", F.lit(7)))
    dealt = dealt.withColumn("block", F.when(far, F.pmod("spot", F.col("n_far"))).otherwise(F.col("n_far") + F.pmod("spot", F.greatest("n_near", F.lit(1)))))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.when(far, F.col("n_far") + F.col("n_near")).otherwise(F.col("n_far")) - 1)))
    grp = F.xxhash64("hub", F.least("block", "other"), F.greatest("block", "other"))
    groups = dealt.select(grp.alias("grp"), grp.alias("least"), "h")
    return compared.where("a is not null and a <> b").select("a", "b"), groups


def _node(h: str = "h", g: str = "g"):
    """Both hashes of a line as one value."""
    return F.unhex(F.concat(F.lpad(F.hex(h), 16, "0"), F.lpad(F.hex(g), 16, "0")))


class _Forest(dict):
    """Nodes joined so far, at most about ``limit`` of them; ``join`` says whether an edge joins anything new."""

    def __init__(self, limit: int):
        super().__init__()
        self.limit = limit

    def top(self, x: bytes) -> bytes:
        while (up := self.setdefault(x, x)) != x:
            self[x] = self[up]
            x = up
        return x

    def join(self, a: bytes, b: bytes) -> bool:
        a, b = self.top(a), self.top(b)
        if a == b:
            return False
        self[max(a, b)] = min(a, b)
        if len(self) > self.limit:
            self.clear()
        return True


def _verified(groups: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Edges of the lines of each of the ``groups (grp, least, h)``. Groups with the same ``least`` meet in a task, which
    compares no lines again that it has joined; any value will do there that a group's lines share."""
    rows = groups.join(texts.select(F.col("h").alias("text_of"), _node().alias("node"), "line"), F.col("h") == F.col("text_of")).select("grp", "node", "line", "least")
    kinds = {"a": pa.binary(), "b": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, own, forest = None, {}, _Forest(200_000)

        def edges(out: dict[str, list]) -> None:
            if len(forest) > forest.limit:
                forest.clear()
            names, number = list(own), {}
            known = [number.setdefault(forest.top(x), len(number)) for x in names]
            if len(number) > 1:
                for i, j in group_edges(list(own.values()), similarity, known):
                    if forest.join(names[i], names[j]):
                        out["a"].append(names[i])
                        out["b"].append(names[j])

        for batch in batches:
            out: dict[str, list] = {"a": [], "b": []}
            for grp, node, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if grp != key:
                    edges(out)
                    key, own = grp, {}
                own[node] = line.as_py()
            yield _arrow(kinds, out)
        last: dict[str, list] = {"a": [], "b": []}
        edges(last)
        yield _arrow(kinds, last)

    return rows.repartition("least").sortWithinPartitions("least", "grp", "node").mapInArrow(run, "a binary, b binary")


def line_links(scratch: Scratch, bodies: DataFrame, signed: DataFrame, similarity: float, crowd: int, crowd_chars: int, broadcast_rows: int) -> DataFrame:
    """Edges ``(a, b)`` of distinct lines, enough to join whatever links among those that share a key."""
    met = scratch.keep(_met(signed.select(F.col("bands").alias("keys"), "h", "chars"), BANDS * signed.count(), crowd, crowd_chars))
    texts = scratch.keep(_texts(bodies, signed, scratch.keep(met.select("h").distinct()), broadcast_rows))
    groups, edges = met.where("key is null").select("grp", "least", "h"), None
    many = met.where("key is not null").select(F.col("h").alias("many_h")).distinct()
    if not many.isEmpty():
        again = texts.join(many, F.col("h") == F.col("many_h"), "left_semi")
        again = scratch.keep(again)
        n_keys = again.agg(F.count("*") + (1 - similarity) * F.sum(F.length("line"))).first()[0]
        met_again = scratch.keep(_met(_prefixed(again, similarity), int(n_keys), crowd, crowd_chars))
        # A crowded line has many more keys: its groups are spread by themselves.
        groups = groups.unionAll(met_again.where("key is null").select("grp", F.col("grp").alias("least"), "h"))
        crowded = met_again.where("key is not null").select("key", "h", "chars")
        if not crowded.isEmpty():
            edges, more = _around_hubs(scratch, crowded, texts, similarity, crowd, crowd_chars)
            groups = groups.unionAll(more)
    found = _verified(groups.distinct(), texts, similarity)
    return found if edges is None else found.unionAll(edges)


def duplicate_lines(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    similarity: float = 0.8,
    min_chars: int = 1,
    crowd: int = 4096,
    crowd_chars: int = 4 << 20,
    broadcast_rows: int = 1_000_000,
    remember: int = 500_000,
) -> DataFrame:
    """``doc, text_hash, removed``: for each document that loses lines their places (from 0), in order.

    Two lines (trimmed, lower case) link if they are equal, or at a Jaccard similarity of ``similarity`` or more of
    their sets of 8-character shingles. Bands find pairs at 0.8 with a probability of 99.1 %; those of fewer than 24
    shingles have keys that miss none; shorter than 8 characters, only equal ones link. Blank lines, and lines of under
    ``min_chars`` characters, stay. Of a component the line first by (doc_id, hash of the text, place) stays;
    nulls come first. Null, empty and blank texts lose nothing. Rows that are equal in id and text count as one
    and are all treated alike. Very long texts are cut into lines in one task; a line of any length is compared
    whole. Other columns are ignored. An empty table gives no rows.

    A line that fills a third of all rows reaches the shuffle once for each task. Lines of keys with over ``crowd``
    lines or ``crowd_chars`` characters meet by their rarest shingles instead; what is still crowded then is compared with
    one of its lines, and those not similar to that one with all others, in blocks. All of this is exact. Texts of the
    compared lines are read again, picked by a broadcast of their hashes where there are at most ``broadcast_rows``
    of them and by a shuffled join beyond.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    bodies = _bodies(docs, doc_id, text)
    signed = scratch.keep(_signed(bodies, min_chars, similarity, remember))
    edges = scratch.keep(line_links(scratch, bodies, signed, similarity, crowd, crowd_chars, broadcast_rows).distinct())
    joined = scratch.keep(components(scratch, edges))
    place = F.struct("doc", "text_hash", "at")
    each = signed.groupBy("h", "g").agg(F.min(place).alias("first"), F.count("*").alias("n")).withColumn("own", _node())
    several = scratch.keep(each.join(joined, F.col("own") == F.col("node"), "left").where("n > 1 or root is not null").select("h", "g", F.coalesce("root", "own").alias("root"), "first"))
    heads = scratch.keep(several.groupBy("root").agg(F.min("first").alias("stays")).withColumnRenamed("root", "of"))
    headed = several.join(heads, F.col("root") == F.col("of")).select(F.col("h").alias("of_h"), F.col("g").alias("of_g"), "stays")
    headed = scratch.keep(headed)
    lost = signed.join(F.broadcast(headed) if headed.count() <= broadcast_rows else headed, (F.col("h") == F.col("of_h")) & (F.col("g") == F.col("of_g")))
    lost = lost.where(~place.eqNullSafe(F.col("stays")))
    return lost.groupBy("doc", "text_hash").agg(F.sort_array(F.collect_set("at")).alias("removed"))


def dedup_lines(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", broadcast_rows: int = 1_000_000, **options) -> DataFrame:
    """``docs`` with the removed lines cut out of ``text``, and the columns ``n_lines`` and ``n_removed``, which take
    the place of columns of these names.

    A text of which nothing but blank lines is left becomes the empty string; null texts stay null, and have one
    line like empty ones. Repeated rows, very long texts, ties and empty tables: see ``duplicate_lines``, which says
    which lines go.
    """
    lost = duplicate_lines(docs, doc_id=doc_id, text=text, broadcast_rows=broadcast_rows, **options)
    lost = Scratch(docs.sparkSession, "lost").keep(lost.select(F.col("doc").alias("__lost_doc"), F.col("text_hash").alias("__lost_hash"), F.col("removed").alias("__lost_lines")))
    body = F.coalesce(F.col(text), F.lit(""))
    met = docs.join(F.broadcast(lost) if lost.count() <= broadcast_rows else lost, F.col(doc_id).cast("long").eqNullSafe(F.col("__lost_doc")) & (F.xxhash64(body) == F.col("__lost_hash")), "left")
    kept = F.array_join(F.filter(F.split(F.col(text), "\n"), lambda x, i: ~F.array_contains("__lost_lines", i)), "\n")
    met = met.withColumns({"n_lines": F.size(F.split(body, "\n")).cast("long"), "n_removed": F.greatest(F.coalesce(F.size("__lost_lines"), F.lit(0)), F.lit(0)).cast("long")})
    return met.withColumn(text, F.when(F.col("__lost_lines").isNull(), F.col(text)).otherwise(kept)).drop("__lost_doc", "__lost_hash", "__lost_lines")
