"""Exact top-k nearest neighbours, for one query or a batch.

Every task keeps the k nearest rows of each query among its rows and gives out only those, with the columns that are asked
for, so what is shuffled is queries x k x tasks rows, whatever the table's size. A row is itself and not its key: keys may
repeat or be missing.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.errors import EngineError
from tessera.functions.distance import METRICS, distance, distances, matrix
from tessera.operators.scan import project

#: Queries held at a time; a larger batch runs in blocks of this many.
QUERY_BLOCK = 2048
ROWS = 2048


class Nearest:
    """The k nearest of many rows for each query, ties by key; `place` says which rows they are."""

    def __init__(self, queries: np.ndarray, k: int, metric: str, digits: int | None) -> None:
        self.queries, self.k, self.metric, self.digits = queries, k, metric, digits
        n = len(queries)
        self.limit = np.full(n, np.inf)
        self.q, self.key, self.place, self.d = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.room = max(4 * n * k, 1 << 16)
        self.seen = 0
        self.rows: list[tuple[np.ndarray, pa.RecordBatch]] = []

    def add(self, keys: np.ndarray, vectors: np.ndarray, only: np.ndarray | None = None, rows: pa.RecordBatch | None = None) -> None:
        """rows: what is to be known of the rows besides their keys, kept for those that may be among the nearest."""
        which = np.arange(len(self.queries)) if only is None else only
        for a in range(0, len(keys), ROWS):
            d = distances(self.queries[which], vectors[a : a + ROWS], self.metric)
            if self.digits is not None:
                d = np.round(d, self.digits) + 0.0
            q, i = np.nonzero(d <= self.limit[which][:, None])
            self.q = np.concatenate([self.q, which[q]])
            self.key = np.concatenate([self.key, keys[a + i]])
            self.place = np.concatenate([self.place, self.seen + a + i])
            self.d = np.concatenate([self.d, d[q, i]])
            if rows is not None and len(i):
                some = np.unique(a + i)
                self.rows.append((self.seen + some, rows.take(pa.array(some))))
            if len(self.q) > self.room:
                self.settle()
        self.seen += len(keys)

    def settle(self) -> None:
        order = np.lexsort((self.place, self.key, self.d, self.q))
        q, d = self.q[order], self.d[order]
        start = np.r_[True, q[1:] != q[:-1]] if len(q) else np.zeros(0, bool)
        rank = np.arange(len(q)) - np.maximum.accumulate(np.where(start, np.arange(len(q)), 0))
        keep = rank < self.k
        full = np.flatnonzero(rank == self.k - 1)
        self.limit[q[full]] = d[full]
        order = order[keep]
        self.q, self.key, self.place, self.d = self.q[order], self.key[order], self.place[order], self.d[order]
        if self.rows:
            places = np.concatenate([p for p, _ in self.rows])
            wanted = np.flatnonzero(np.isin(places, self.place))
            held = pa.Table.from_batches([r for _, r in self.rows]).take(pa.array(wanted)).combine_chunks()
            self.rows = [(places[wanted], held.to_batches()[0])] if len(wanted) else []

    def batch(self, first: int) -> pa.RecordBatch:
        self.settle()
        out = {"query_idx": pa.array(self.q + first), "__key": pa.array(self.key), "distance": pa.array(self.d)}
        if self.rows:
            places, held = self.rows[0]
            order = np.argsort(places)
            taken = held.take(pa.array(order[np.searchsorted(places, self.place, sorter=order)]))
            out |= dict(zip(held.schema.names, taken.columns, strict=True))
        return pa.RecordBatch.from_pydict(out)


def check_query(vector: Sequence[float], width: int | None) -> list[float]:
    got = [float(x) for x in vector]
    if not got:
        raise EngineError("The query vector is empty.")
    if width and len(got) != width:
        raise EngineError(f"The query has {len(got)} dimensions, the column {width}.")
    return got


def tie_break(df: DataFrame, key: str | None) -> Column:
    """The number that decides between rows at one distance: the key, or a hash of the whole row where there is none."""
    return F.col(f"`{key}`").cast("long") if key else F.xxhash64(*[F.col(f"`{c}`").cast("string") for c in df.columns])


def _winners(df: DataFrame, column: str, key: str | None, queries: np.ndarray, first: int, k: int, metric: str, digits: int | None, columns: Sequence[str]) -> DataFrame:
    """(query_idx, __key, distance, c0, c1, ..., __rank): the nearest rows with their columns."""
    width = queries.shape[1]
    own = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)]
    rows = df.select(tie_break(df, key).alias("__key"), F.col(f"`{column}`").alias("__v"), *own).where("__key is not null and __v is not null")
    names = [f"c{i}" for i in range(len(columns))]
    schema = T.StructType([T.StructField("query_idx", T.LongType()), T.StructField("__key", T.LongType()), T.StructField("distance", T.DoubleType()), *[T.StructField(n, df.schema[c].dataType) for n, c in zip(names, columns, strict=True)]])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Nearest(queries, k, metric, digits)
        for batch in batches:
            at, vectors = matrix(batch.column("__v"), width)
            if len(at):
                live = batch.take(pa.array(at))
                found.add(live.column("__key").to_numpy(zero_copy_only=False), vectors, rows=live.select(names) if names else None)
        if found.seen:
            yield found.batch(first)

    partial = rows.mapInArrow(search, schema)
    order = Window.partitionBy("query_idx").orderBy("distance", "__key")
    return partial.withColumn("__rank", F.row_number().over(order)).where(F.col("__rank") <= k)


def knn_batch(df: DataFrame, column: str, key: str | None, queries: DataFrame | Sequence[Sequence[float]], k: int, metric: str = "l2", projection: str = "*", digits: int | None = None, query_column: str = "query", query_key: str | None = None, ranked: bool = False) -> DataFrame:
    """The k nearest rows of each query, with query_idx first and distance where the projection names it ('*': last).

    queries: vectors, or a DataFrame with `query_column`, numbered by `query_key` (its own numbers) or in the order given.
    Ties go to the smaller key, or without a key column to the smaller hash of the row; rows that share a key are found each
    for itself. ranked: with a last column __rank, from 1, in each query's order. `digits` rounds distances before they are compared. A k above the number of rows gives all
    rows. Null vectors, vectors of other sizes and rows without a key are never found.
    """
    if k < 1:
        raise EngineError("k must be at least 1.")
    if metric not in METRICS:
        raise EngineError(f"Unknown metric: {metric}")
    spark = df.sparkSession
    blocks: list[tuple[int, np.ndarray]] = []
    numbers: list[int] | None = None
    if isinstance(queries, DataFrame):
        if query_column not in queries.columns:
            raise EngineError(f"Queries need a column named '{query_column}'.")
        kind = queries.schema[query_column].dataType
        if not isinstance(kind, T.ArrayType) or not isinstance(kind.elementType, T.FloatType | T.DoubleType):
            raise EngineError(f"Column '{query_column}' must hold lists of floats.")
        chosen = queries.select(*([F.col(query_key).cast("long").alias("n")] if query_key else []), F.col(query_column).alias("v"))
        rows, numbers = [], [] if query_key else None
        for r in (chosen.orderBy("n") if query_key else chosen).toLocalIterator():
            rows.append(check_query(r.v, len(rows[0]) if rows else None))
            if query_key:
                numbers.append(r.n)
    else:
        rows = [check_query(v, len(queries[0])) for v in queries]
    for a in range(0, len(rows), QUERY_BLOCK):
        blocks.append((a, np.array(rows[a : a + QUERY_BLOCK])))
    columns = project(projection or "*", [*df.columns, "distance"], hidden=())
    own = [c for c in columns if c != "distance"]
    out = None
    for first, block in blocks:
        part = _winners(df, column, key, block, first, k, metric, digits, own)
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = _winners(df.limit(0), column, key, np.zeros((1, 1)), 0, k, metric, digits, own)
    if numbers is not None:
        named = spark.createDataFrame(list(enumerate(numbers)), "query_idx long, __n long")
        out = out.join(F.broadcast(named), "query_idx").withColumn("query_idx", F.col("__n")).drop("__n")
    shown = [F.col("distance") if c == "distance" else F.col(f"c{own.index(c)}").alias(c) for c in columns]
    return out.select("query_idx", *shown, *["__rank"] * ranked)


def knn(df: DataFrame, column: str, key: str | None, query: Sequence[float], k: int, metric: str = "l2", projection: str = "*", digits: int | None = None) -> DataFrame:
    """The k nearest rows, nearest first; as knn_batch for one query."""
    return knn_batch(df, column, key, [query], k, metric, projection, digits, ranked=True).orderBy("__rank").drop("query_idx", "__rank")


def within(df: DataFrame, column: str, query: Sequence[float], radius: float, metric: str = "l2") -> DataFrame:
    """The rows at most `radius` away, with their distance."""
    return df.withColumn("distance", distance(F.col(f"`{column}`"), query, metric)).where(F.col("distance") <= radius)


def with_distance(df: DataFrame, column: str, query: Sequence[float], metric: str = "l2") -> DataFrame:
    """All rows with their distance."""
    return df.withColumn("distance", distance(F.col(f"`{column}`"), query, metric))


def exact_ids(spark: SparkSession, df: DataFrame, column: str, key: str, queries: Sequence[Sequence[float]], k: int, metric: str) -> list[set[int]]:
    """The keys of the k nearest rows of each query."""
    out: list[set[int]] = [set() for _ in queries]
    for r in knn_batch(df, column, key, queries, k, metric, key).collect():
        out[r.query_idx].add(r[key])
    return out
