"""Exact nearest rows of many queries: blocks of queries against cells of vectors, each pair one matrix product."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Queries of a block, rows of a cell, and scores that a task holds at once.
BLOCK_ROWS, CELL_ROWS, SCORES_AT_ONCE = 16_384, 131_072, 1_000_000
#: Rows of a cell under which more cells would only cost more tasks.
LEAST_CELL = 2_048


def _sizes(column: pa.ChunkedArray) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(column), -1).to_numpy()


def _matrix(column: pa.ChunkedArray, rows: np.ndarray, dim: int) -> np.ndarray:
    flat = pc.list_flatten(column.take(pa.array(rows)))
    return flat.to_numpy().astype(np.float64).reshape(len(rows), dim)


def _codes(*columns: pa.ChunkedArray) -> list[np.ndarray]:
    """The columns' values as numbers that are equal where the values are; -1 for null."""
    both = pa.chunked_array([c for col in columns for c in col.cast(columns[-1].type).chunks], type=columns[-1].type).combine_chunks()
    codes = pc.fill_null(both.dictionary_encode().indices, -1).to_numpy()
    return np.split(codes, np.cumsum([len(c) for c in columns])[:-1])


def _best(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of each row's ``k`` largest scores, the earlier ones of equal scores; -inf is none."""
    chosen = scores > -np.inf
    if scores.shape[1] > k:
        least = np.partition(scores, -k, axis=1)[:, -k][:, None]
        above, tied = scores > least, scores == least
        need = k - above.sum(axis=1)
        many = np.flatnonzero(tied.sum(axis=1) > need)
        tied[many] &= np.cumsum(tied[many], axis=1, dtype=np.int32) <= need[many, None]
        chosen &= above | tied
    return np.nonzero(chosen)


def _rounded(scores: np.ndarray) -> np.ndarray:
    return np.copysign(np.floor(np.abs(scores) * 1e6 + 0.5) / 1e6, scores) + 0.0


def _search(k: int, same: tuple[str, str] | None, per: str | None, given: list[str]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(asked: pa.Table, cell: pa.Table) -> pa.Table:
        cell = cell.take(pc.sort_indices(cell, sort_keys=[("id", "ascending")], null_placement="at_start"))
        q_size, v_size = _sizes(asked["q"]), _sizes(cell["vector"])
        q_same, v_same = _codes(asked[same[1]], cell[same[0]]) if same else (None, None)
        parts = _codes(cell[per])[0] if per else np.zeros(len(v_size), dtype=np.int32)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for dim in np.unique(q_size[q_size >= 0]):
            rows, cols = np.flatnonzero(q_size == dim), np.flatnonzero(v_size == dim)
            if not len(cols):
                continue
            cols = cols[np.argsort(parts[cols], kind="stable")]
            seams = np.flatnonzero(np.diff(parts[cols])) + 1
            ranges = list(zip([0, *seams], [*seams, len(cols)], strict=True))
            queries, vectors = _matrix(asked["q"], rows, dim), _matrix(cell["vector"], cols, dim).T
            step = max(1, SCORES_AT_ONCE // len(cols))
            for at in range(0, len(rows), step):
                scores = _rounded(queries[at : at + step] @ vectors)
                scores[np.isnan(scores)] = -np.inf
                if same:
                    own = q_same[rows[at : at + step], None]
                    scores[(own != v_same[cols]) | (own < 0)] = -np.inf
                for first, end in ranges:
                    r, c = _best(scores[:, first:end], k)
                    found.append((rows[at + r], cols[first + c], scores[r, first + c]))
        r, c, s = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        left, right = asked.select(["qid"]).take(pa.array(r)), cell.select(given).take(pa.array(c))
        return pa.table([left["qid"], *(right[n] for n in given), pa.array(s, pa.float64())], names=["qid", *given, "score"])

    return run


def nearest(queries: DataFrame, vectors: DataFrame, k: int, same: tuple[str, str] | None = None, per: str | None = None, carry: tuple[str, ...] = (), block_rows: int = BLOCK_ROWS, cell_rows: int = CELL_ROWS) -> DataFrame:
    """``qid, [per], id, *carry, score``: of each pair of a block of ``queries (qid, q)`` and a cell of ``vectors (id, vector)``
    every query's k best rows by dot product, the lower ids of equal scores; all that can be among the k best of the
    whole table are there. ``same (a, b)``: only rows whose ``a`` is the query's ``b``; ``per``: k in each value of that column.

    Both sides are spread by a hash of their ids and held in parts of bounded size, so neither has to fit in
    memory and a frequent value of any column makes no part larger. Null vectors, vectors of another length than
    the query's, products that are no number and nulls in ``same`` are no candidates; empty tables give no rows.
    """
    given = [*([per] if per else []), "id", *carry]
    n, asked = vectors.count(), queries.count()
    blocks = max(1, -(-asked // block_rows))
    cells = max(1, -(-n // cell_rows), min(vectors.sparkSession.sparkContext.defaultParallelism, -(-n // LEAST_CELL)))
    part = lambda key, of: F.pmod(F.xxhash64(key), F.lit(of)).cast("int")
    each = lambda of: F.explode(F.sequence(F.lit(0), F.lit(of - 1)))
    left = queries.select("qid", "q", *([same[1]] if same else []), part("qid", blocks).alias("__block")).withColumn("__cell", each(cells))
    needed = dict.fromkeys([*given, "vector", *([same[0]] if same else [])])
    right = vectors.select(*needed, part("id", cells).alias("__cell")).withColumn("__block", each(blocks))
    kinds = {f.name: f.dataType for f in vectors.schema}
    out = T.StructType([T.StructField("qid", queries.schema["qid"].dataType), *(T.StructField(c, kinds[c]) for c in given), T.StructField("score", T.DoubleType())])
    return left.groupBy("__block", "__cell").cogroup(right.groupBy("__block", "__cell")).applyInArrow(_search(k, same, per, given), out)
