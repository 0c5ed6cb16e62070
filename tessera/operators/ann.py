"""Approximate nearest neighbours with an inverted file.

Cells are the centroids of k-means on a bounded sample; every row is in its nearest cell and the cells are partitions on
disk. A query looks into its `nprobe` nearest cells only, which is a partition filter. Recall rises with nprobe to that of
the exact search.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.distance import distances, matrix
from tessera.operators.knn import Nearest
from tessera.sources.storage import Storage

#: Vectors that the cells are fitted on.
SAMPLE = 20_000
CELL = "__cell"


def fit_cells(vectors: np.ndarray, cells: int, metric: str, rounds: int = 12, seed: int = 0) -> np.ndarray:
    """Centroids by Lloyd's rounds; on the sphere for inner product and cosine."""
    r = np.random.default_rng(seed)
    centres = vectors[r.choice(len(vectors), min(cells, len(vectors)), replace=False)].copy()
    for _ in range(rounds):
        own = distances(centres, vectors, "l2").argmin(0)
        count = np.bincount(own, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, own, vectors)
        centres = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centres)
        if metric != "l2":
            centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    return centres


@dataclass
class IvfIndex:
    path: str
    column: str
    key: str
    metric: str
    centres: np.ndarray

    def search(self, spark: SparkSession, queries: np.ndarray, k: int, nprobe: int | None = None, digits: int | None = None, live: DataFrame | None = None) -> DataFrame:
        """(query_idx, key, distance) of the k nearest rows in the nprobe nearest cells; all cells give the exact result.

        live: the rows (__key, __v) as they are now, where they have changed since the index was built. Those that the index
        has as they are stand in their cells, others are not found; rows that it lacks are looked at by every query.
        """
        queries = np.asarray(queries, float)
        nprobe = min(nprobe or max(1, len(self.centres) // 4), len(self.centres))
        near = np.argsort(distances(queries, self.centres, "l2" if self.metric == "l2" else "ip"), axis=1, kind="stable")[:, :nprobe]
        asks: dict[int, np.ndarray] = {c: np.flatnonzero((near == c).any(1)) for c in np.unique(near).tolist()}
        held = spark.read.parquet(self.path).select("__key", "__v", CELL)
        rows = held.where(F.col(CELL).isin(*asks))
        if live is not None:
            same = lambda df: df.withColumn("__h", F.xxhash64("__v"))
            fresh = same(live).join(same(held).select("__key", "__h"), ["__key", "__h"], "left_anti").select("__key", "__v", F.lit(-1).alias(CELL))
            rows = same(rows).join(same(live).select("__key", "__h"), ["__key", "__h"], "left_semi").select("__key", "__v", CELL).unionByName(fresh)
            asks[-1] = np.arange(len(queries))
        metric, width = self.metric, queries.shape[1]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = Nearest(queries, k, metric, digits)
            for batch in batches:
                cells = batch.column(CELL).to_numpy(zero_copy_only=False)
                at, vectors = matrix(batch.column("__v"), width)
                keys = batch.column("__key").to_numpy(zero_copy_only=False)[at]
                for c in np.unique(cells[at]).tolist():
                    mine = cells[at] == c
                    found.add(keys[mine], vectors[mine], asks[c])
            yield found.batch(0)

        best = Window.partitionBy("query_idx").orderBy("distance", "__key")
        top = rows.mapInArrow(run, "query_idx long, __key long, distance double").withColumn("__r", F.row_number().over(best)).where(F.col("__r") <= k)
        return top.select("query_idx", F.col("__key").alias(self.key), "distance")


def build_ivf(df: DataFrame, column: str, key: str, metric: str, path: str, cells: int | None = None, sample: int = SAMPLE) -> IvfIndex:
    """Index every row with a vector and a key below `path`; the cells are fitted on at most `sample` rows, by a hash of their key."""
    spark = df.sparkSession
    rows = df.select(F.col(f"`{key}`").cast("long").alias("__key"), F.col(f"`{column}`").alias("__v")).where("__key is not null and __v is not null")
    picked = rows.orderBy(F.xxhash64("__key"), "__key").limit(sample).select("__v").toArrow()["__v"]
    width = len(picked[0].as_py()) if len(picked) else 1
    _, vectors = matrix(picked, width)
    centres = fit_cells(vectors, cells or max(1, int(len(vectors) ** 0.5)), metric) if len(vectors) else np.zeros((1, width))
    space = "l2" if metric == "l2" else "ip"

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, found = matrix(batch.column("__v"), width)
            cell = distances(centres, found, space).argmin(0) if len(found) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_pydict({"__key": batch.column("__key").take(pa.array(at)), "__v": batch.column("__v").take(pa.array(at)), CELL: pa.array(cell.astype(np.int32))})

    element = df.schema[column].dataType.simpleString()
    rows.mapInArrow(assign, f"__key long, __v {element}, {CELL} int").hint("rebalance", CELL).write.partitionBy(CELL).parquet(path)
    storage = Storage(spark, path)
    storage.write(json.dumps({"column": column, "key": key, "metric": metric, "centres": centres.tolist()}), "_index.json")
    return IvfIndex(path, column, key, metric, centres)


def open_ivf(spark: SparkSession, path: str) -> IvfIndex:
    m = json.loads(Storage(spark, path).read("_index.json"))
    return IvfIndex(path, m["column"], m["key"], m["metric"], np.array(m["centres"]))
