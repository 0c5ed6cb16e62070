"""Vector distances as expressions, and as matrix products over Arrow batches."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.errors import EngineError

#: l2: the sum of squared differences (no root). ip: one minus the inner product. cosine: one minus the cosine.
METRICS = ("l2", "ip", "cosine")
SPACES = {"l2space": "l2", "ipspace": "ip"}


def metric_of(space: str | None) -> str:
    """The metric of an index space; anything unknown is the inner product."""
    low = (space or "").lower()
    return SPACES.get(low, low if low in METRICS else "ip")


def distance(vector: Column, query: Sequence[float] | Column, metric: str) -> Column:
    """The distance of a vector column from a query, in double precision; null if either is null or their sizes differ."""
    q = query if isinstance(query, Column) else F.array(*[F.lit(float(x)) for x in query])
    a, b = vector.cast("array<double>"), q.cast("array<double>")
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, x: s + x)
    dot = total(F.zip_with(a, b, lambda x, y: x * y))
    if metric == "l2":
        out = total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))
    elif metric == "ip":
        out = F.lit(1.0) - dot
    elif metric == "cosine":
        norm = lambda v: F.sqrt(total(F.transform(v, lambda x: x * x)))
        out = F.lit(1.0) - F.try_divide(dot, norm(a) * norm(b))
    else:
        raise EngineError(f"Unknown metric: {metric}")
    return F.when(F.size(a) == F.size(b), out + F.lit(0.0))


def matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, vectors): the places of the vectors of `width` numbers without nulls, and those vectors in double precision."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = column.offsets.to_numpy().astype(np.int64)
    ok = (np.diff(offsets) == width) & column.is_valid().to_numpy(zero_copy_only=False)
    values = column.values
    if values.null_count:
        gaps = np.concatenate([[0], np.cumsum(values.is_null().to_numpy(zero_copy_only=False))])
        ok &= gaps[offsets[1:]] == gaps[offsets[:-1]]
    rows = np.flatnonzero(ok)
    flat = values.to_numpy(zero_copy_only=False).astype(np.float64)
    return rows, flat[offsets[:-1][rows][:, None] + np.arange(width)] if len(rows) else np.zeros((0, width))


def distances(queries: np.ndarray, vectors: np.ndarray, metric: str) -> np.ndarray:
    """Queries x vectors."""
    dot = queries @ vectors.T
    if metric == "l2":
        return np.maximum((queries**2).sum(1)[:, None] + (vectors**2).sum(1)[None] - 2 * dot, 0.0)
    if metric == "cosine":
        norms = np.linalg.norm(queries, axis=1)[:, None] * np.linalg.norm(vectors, axis=1)[None]
        return 1.0 - np.divide(dot, norms, out=np.full_like(dot, np.nan), where=norms > 0)
    return 1.0 - dot
