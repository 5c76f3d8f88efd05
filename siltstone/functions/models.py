"""Places for models: encoders and pair scorers as iterator pandas UDFs that load once a worker, and vectors as bytes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_loaded: dict[str, object] = {}


def _once(name: str, load: Callable[[], object]) -> object:
    if name not in _loaded:
        _loaded[name] = load()
    return _loaded[name]


def encoder(text: Column, name: str, load: Callable[[], Callable[[list[str]], np.ndarray]], batch: int = 64) -> Column:
    """``array<float>`` of each text, of Euclidean length 1 (a zero vector stays). ``load`` returns a function from texts to
    a matrix; it runs once a worker under ``name``. Null texts are empty ones; ``batch`` texts are encoded at a time."""

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = _once(name, load)
        for part in parts:
            out: list = []
            texts = part.fillna("").tolist()
            for s in range(0, len(texts), batch):
                own = np.asarray(encode(texts[s : s + batch]), dtype=np.float32)
                norm = np.linalg.norm(own, axis=1, keepdims=True)
                out.extend(own / np.where(norm > 0, norm, 1))
            yield pd.Series(out, dtype="object")

    return run(text)


def pair_scorer(query: Column, text: Column, name: str, load: Callable[[], Callable[[list[tuple[str, str]]], np.ndarray]], batch: int = 64) -> Column:
    """A score for each query and text. ``load`` returns a function from pairs to scores; it runs once a worker."""

    @F.pandas_udf("double")
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        score = _once(name, load)
        for q, t in parts:
            pairs = list(zip(q.fillna("").tolist(), t.fillna("").tolist(), strict=True))
            out = [float(x) for s in range(0, len(pairs), batch) for x in score(pairs[s : s + batch])]
            yield pd.Series(out, dtype="float64")

    return run(query, text)


def vector_bytes(vector: Column) -> Column:
    """A vector as little-endian 32-bit floats."""

    @F.pandas_udf("binary")
    def run(rows: pd.Series) -> pd.Series:
        return rows.map(lambda v: None if v is None else np.asarray(v, dtype="<f4").tobytes())

    return run(vector)


def vector_of_bytes(blob: Column) -> Column:
    """The vector that ``vector_bytes`` wrote."""

    @F.pandas_udf("array<float>")
    def run(rows: pd.Series) -> pd.Series:
        return rows.map(lambda b: None if b is None else np.frombuffer(b, dtype="<f4"))

    return run(blob)
