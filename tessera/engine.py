"""The engine: tables and every command on them."""

from __future__ import annotations

import json
import logging
import time
from collections import defaultdict
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.errors import ColumnNotFound, EngineError
from tessera.functions.filters import Predicate, equalities, guard_reserved, parse_assignments, parse_filter
from tessera.operators import stats
from tessera.operators.ann import IvfIndex, build_ivf
from tessera.operators.cursor import CursorRegistry
from tessera.operators.knn import check_query, knn, knn_batch, tie_break
from tessera.operators.scan import debug_scan, scan
from tessera.sources.catalog import ACTIVE_SET_SIZE_LIMIT, LAYERS, SEGMENTS_LISTED, Catalog, Table
from tessera.sources.rows import conform, from_ipc, text_row
from tessera.sources.segment import BUCKET
from tessera.sources.storage import Storage
from tessera.types import DELETED, extended, violations

LOG_TOPICS = ("catalog", "scan", "search", "insert", "delete", "update", "snapshot")


class Engine:
    def __init__(self, spark: SparkSession, root: str, cursor_ttl: float = 600.0) -> None:
        spark.conf.set("spark.sql.caseSensitive", "true")
        self.spark = spark
        self.catalog = Catalog(spark, root)
        self.cursors = CursorRegistry(cursor_ttl)
        self.ivf: dict[tuple[str, str], IvfIndex] = {}
        self.built: dict[tuple[str, str], tuple[str, int]] = {}
        self.metrics: dict[str, list[float]] = defaultdict(lambda: [0, 0.0])
        self.logs = {t: logging.getLogger(f"tessera.{t}") for t in LOG_TOPICS}
        self.topics: set[str] = set()
        self.settings: dict[str, int] = {"active-set-size-limit": ACTIVE_SET_SIZE_LIMIT, "cursor-ttl": int(cursor_ttl)}

    @contextmanager
    def _timed(self, what: str, topic: str) -> Iterator[None]:
        began = time.monotonic()
        try:
            yield
        finally:
            self.metrics[what][0] += 1
            self.metrics[what][1] += time.monotonic() - began
            if topic in self.topics:
                self.logs[topic].info("%s took %.3f s", what, time.monotonic() - began)

    # Definitions

    def create(self, schema: str | T.StructType, name: str, **metadata: object) -> None:
        self.catalog.create(schema, {"table name": name, "active_set_size_limit": self.settings["active-set-size-limit"]} | metadata)

    def drop(self, name: str) -> None:
        self.catalog.drop(name)

    def list_tables(self) -> list[str]:
        return self.catalog.names()

    def describe(self, name: str, internal: bool = False) -> T.StructType:
        schema = self.catalog.get(name).schema
        return extended(schema) if internal else schema

    # Reading

    def table(self, name: str, values: dict[str, list[object]] | None = None) -> DataFrame:
        """All rows with the deletion flag. values: those that key columns are known to have, to leave out buckets."""
        t = self.catalog.get(name)
        df = self.catalog.read(t)
        if values and (kept := t.segmentation.pruned(values, t.schema)) is not None:
            df = df.where(kept)
        return df.drop(BUCKET)

    def _filtered(self, name: str, filter_text: str, internal: bool = False) -> tuple[DataFrame, Predicate | None]:
        schema = extended(self.catalog.get(name).schema)
        tree = parse_filter(filter_text, schema)
        if not internal:
            guard_reserved(tree)
        return self.table(name, equalities(tree)), tree

    def scan(self, name: str, projection: str = "*", filter_text: str = "", limit: int = 0, internal: bool = False) -> DataFrame:
        with self._timed("Scan", "scan"):
            df, _ = self._filtered(name, filter_text, internal)
            return scan(self._typed(df, name), projection, filter_text, limit, internal)

    def _typed(self, df: DataFrame, name: str) -> DataFrame:
        """df with the declared field metadata, which literals are checked against."""
        schema = extended(self.catalog.get(name).schema)
        return df.select(*[F.col(f"`{f.name}`").alias(f.name, metadata=f.metadata) if f.metadata else F.col(f"`{f.name}`") for f in schema.fields])

    def debug_scan(self, name: str, projection: str = "*", filter_text: str = "") -> str:
        df, _ = self._filtered(name, filter_text)
        return debug_scan(self._typed(df, name), projection, filter_text)

    def scan_open(self, uuid: str, name: str, projection: str = "*", filter_text: str = "", limit: int = 0, internal: bool = False, page: int | None = None) -> tuple[pa.Table, bool]:
        return self.cursors.open(uuid, self.scan(name, projection, filter_text, limit, internal), page or self.catalog.get(name).limit)

    def fetch_next(self, uuid: str) -> tuple[pa.Table, bool]:
        return self.cursors.fetch(uuid)

    # Search

    def _searched(self, name: str, column: str, filter_text: str) -> tuple[DataFrame, dict, str | None]:
        t = self.catalog.get(name)
        index = self.catalog.vector_column(t, column)
        df, tree = self._filtered(name, filter_text)
        df = df.where(~F.col(DELETED)).drop(DELETED)
        df = df.where(tree.column()) if tree else df
        key = t.primary_key if t.primary_key and isinstance(t.schema[t.primary_key].dataType, T.IntegralType) else next((f.name for f in t.schema.fields if isinstance(f.dataType, T.IntegralType)), None)
        return df, index, key

    def _width(self, name: str, column: str) -> int:
        return self.catalog.get(name).schema[column].metadata["list_size"]

    def ann(self, name: str, column: str, k: int, query: Sequence[float], ef: int | None = None, projection: str = "*", filter_text: str = "") -> DataFrame:
        """The k nearest live rows that the filter holds for, nearest first. Exact, so that ef is checked and else unused."""
        self._check_k(k, ef)
        with self._timed("AnnCommand", "search"):
            df, index, key = self._searched(name, column, filter_text)
            found = knn(df, column, key, check_query(query, self._width(name, column)), k, index["metric"], projection or "*")
            return found.withColumn("distance", F.col("distance").cast("float")) if "distance" in found.columns else found

    def batch_ann(self, name: str, column: str, k: int, queries: DataFrame | Sequence[Sequence[float]], ef: int | None = None, projection: str = "*", filter_text: str = "") -> DataFrame:
        """As ann for many queries at once, with query_idx first; in order of query_idx, then nearest first."""
        self._check_k(k, ef)
        with self._timed("BatchAnnCommand", "search"):
            df, index, key = self._searched(name, column, filter_text)
            if not isinstance(queries, DataFrame):
                queries = [check_query(q, self._width(name, column)) for q in queries]
            found = knn_batch(df, column, key, queries, k, index["metric"], projection or "*", ranked=True).orderBy("query_idx", "__rank").drop("__rank")
            return found.withColumn("distance", F.col("distance").cast("float")) if "distance" in found.columns else found

    @staticmethod
    def _check_k(k: int, ef: int | None) -> None:
        if k < 1 or (ef is not None and ef < 1):
            raise EngineError("k and ef must be at least 1.")

    def build_index(self, name: str, column: str, path: str, cells: int | None = None) -> IvfIndex:
        """An inverted file over the live rows, for approximate search. Later changes are seen by searches, at more cost until it is built again."""
        df, index, key = self._searched(name, column, "")
        if key is None:
            raise EngineError("An index needs an integer column to name the rows by.")
        self.ivf[name, column] = build_ivf(df, column, key, index["metric"], path, cells)
        self.built[name, column] = self.catalog.get(name).folder, self.catalog.get(name).version
        return self.ivf[name, column]

    def approximate_ann(self, name: str, column: str, k: int, queries: Sequence[Sequence[float]], ef: int | None = None) -> DataFrame:
        """The nearest rows by the column's inverted file: in two thirds of the cells, by test a recall at 10 of 0.9; an ef or k above that share of 200 looks into more, 200 into all."""
        if (name, column) not in self.ivf:
            raise EngineError(f"Column '{column}' of table '{name}' has no built index.")
        self._check_k(k, ef)
        index, t = self.ivf[name, column], self.catalog.get(name)
        live = None
        if self.built[name, column] != (t.folder, t.version):
            df, _, key = self._searched(name, column, "")
            live = df.select(tie_break(df, key).alias("__key"), F.col(f"`{column}`").alias("__v")).where("__key is not null and __v is not null")
        nprobe = max(-(-len(index.centres) * 2 // 3), -(-len(index.centres) * max(k, ef or k) // 200))
        return index.search(self.spark, [check_query(q, self._width(name, column)) for q in queries], k, nprobe, live=live)

    # Writing

    def insert_text(self, name: str, row: str) -> None:
        """One row of text; its primary key isn't looked up, unlike that of a batch."""
        t = self.catalog.get(name)
        with self._timed("InsertCommand", "insert"):
            self._append(t, text_row(self.spark, row, t.schema))

    def insert(self, name: str, rows: DataFrame | pa.Table | bytes, stream: tuple[str, int] | None = None) -> int:
        """Rows by place, each to its own segment. Rows whose primary key the segment has are skipped; the number that came in.

        stream: the name of a stream and the number of its batch; a batch that the table has already adds nothing.
        """
        t = self.catalog.get(name)
        if stream and t.streams.get(stream[0], -1) >= stream[1]:
            return 0
        with self._timed("BatchInsertCommand", "insert"):
            df = rows if isinstance(rows, DataFrame) else from_ipc(self.spark, rows) if isinstance(rows, bytes) else self.spark.createDataFrame(rows)
            df = conform(df, t.schema)
            if key := t.primary_key:
                repeated = df.where(F.col(f"`{key}`").isNotNull()).groupBy(key, *[k for k in t.segmentation.keys if k != key]).count().where("count > 1").limit(1).collect()
                if repeated:
                    raise EngineError(f"Primary key {repeated[0][key]!r} comes twice in one batch.")
                on = list(dict.fromkeys([key, *t.segmentation.keys]))
                df = df.join(self.table(name).where(~F.col(DELETED)).select(*on), on, "left_anti").select(*t.schema.names)
            return self._append(t, df, stream)

    def _append(self, t: Table, df: DataFrame, stream: tuple[str, int] | None = None) -> int:
        broken = violations(t.schema)
        seen = F.when(broken.isNull(), F.lit(False)).otherwise(F.raise_error(F.concat(F.lit("Wrong rows: "), broken)).cast("boolean"))
        layer = self.catalog.write(t, df.withColumn(DELETED, seen))
        n = self.spark.read.parquet(f"{self.catalog.storage.root}/{t.folder}/{layer['path']}").count()
        if n or stream:
            if stream:
                t.streams = t.streams | {stream[0]: stream[1]}
            self.catalog.commit(t, [*t.layers, layer] if n else t.layers)
        if len(t.layers) > LAYERS:
            self.compact(t.name)
        return n

    def delete(self, name: str, filter_text: str = "") -> int:
        """Mark the rows that the filter holds for, all without one; how many."""
        with self._timed("DeleteCommand", "delete"):
            return self._change(name, filter_text, lambda rows, hit: rows.withColumn(DELETED, F.col(DELETED) | hit))

    def update(self, name: str, assignments: str, filter_text: str = "") -> int:
        """Replace values in the rows that the filter holds for: the old rows are marked deleted and the new ones added, in one step."""
        t = self.catalog.get(name)
        values = parse_assignments(assignments, t.schema)

        def change(rows: DataFrame, hit: Column) -> DataFrame:
            old = rows.withColumn(DELETED, F.col(DELETED) | hit)
            new = rows.where(hit)
            for column, (value, f) in values.items():
                literal = F.array(*[F.lit(v) for v in value]) if isinstance(value, list) else F.lit(value)
                new = new.withColumn(column, literal.cast(f.dataType))
            return old.unionByName(new)

        with self._timed("UpdateCommand", "update"):
            key = t.primary_key
            if key and key in values:
                value = values[key][0]
                df, tree = self._filtered(name, filter_text)
                hit = ~F.col(DELETED) & (F.coalesce(tree.column(), F.lit(False)) if tree else F.lit(True))
                taken = df.where(~F.col(DELETED)).agg(F.count_if(hit).alias("n"), F.count_if(~hit & (F.col(f"`{key}`") == F.lit(value).cast(t.schema[key].dataType))).alias("m")).first()
                if taken.n > 1 or (taken.n and taken.m):
                    raise EngineError(f"The update would give several rows the primary key {value!r}.")
            return self._change(name, filter_text, change)

    def _change(self, name: str, filter_text: str, change) -> int:
        """Rewrite the segments that have rows to change; nothing is visible before the manifest."""
        t = self.catalog.get(name)
        tree = parse_filter(filter_text, t.schema)
        guard_reserved(tree)
        hit = ~F.col(DELETED) & (F.coalesce(tree.column(), F.lit(False)) if tree else F.lit(True))
        everything = self.catalog.read(t)
        seg = t.segmentation
        if seg.kind:
            pruned = seg.pruned(equalities(tree), t.schema)
            where = everything.where(pruned) if pruned is not None else everything
            by = where.where(hit).groupBy(*seg.columns()).agg(F.count("*").alias("__n"))
            total = by.agg(F.sum("__n").alias("n"), F.count("*").alias("s")).first()
            if not total.n:
                return 0
            touched = None
            if total.s + max([len(x["minus"]) for x in t.layers], default=0) <= SEGMENTS_LISTED:
                touched = [[_plain(r[c]) for c in seg.columns()] for r in by.collect()]
            rows = everything.where(self.catalog._in_segments(t, touched)) if touched is not None else everything
            n = total.n
        else:
            touched, rows = None, everything
            n = everything.where(hit).count()
            if not n:
                return 0
        self.catalog.replace(t, touched, self.catalog.write(t, change(rows.drop(BUCKET), hit)))
        return n

    def compact(self, name: str) -> None:
        """Write the table's live and deleted rows as one layer."""
        t = self.catalog.get(name)
        self.catalog.replace(t, None, self.catalog.write(t, self.catalog.read(t).drop(BUCKET)))

    def vacuum(self, name: str) -> int:
        """Delete the files of earlier states of the table; the number of layers that went."""
        return self.catalog.vacuum(self.catalog.get(name))

    # Counters

    def count_records(self, name: str) -> int:
        return stats.count_records(self.table(name)).first().n

    def total_record_count(self) -> tuple[int, int]:
        names = self.list_tables()
        got = stats.total_counts([self.table(n).select(DELETED) for n in names]).first() if names else (0, 0)
        return got[0], got[1]

    def total_table_count(self) -> tuple[int, int]:
        """(tables, unloaded ones, which are never counted)."""
        return len(self.catalog.tables), 0

    def count_indexed_elements(self, name: str) -> tuple[int, dict[str, tuple[str, int]]]:
        t = self.catalog.get(name)
        row = stats.count_indexed(self.table(name), list(t.indexes)).first()
        return row.n, {c: ("Hnsw", row[c]) for c in t.indexes}

    def segment_statistics_frame(self, name: str) -> DataFrame:
        t = self.catalog.get(name)
        return stats.segment_statistics(self.catalog.read(t), t.segmentation.id(), t.name, t.limit, list(t.indexes))

    def segment_statistics(self, name: str | None = None) -> str:
        out = []
        for n in [name] if name else self.list_tables():
            out += [r.asDict(recursive=True) for r in self.segment_statistics_frame(n).orderBy("segment_id").collect()]
        return json.dumps({"segment_statistics": out})

    def check_indexing(self, name: str) -> bool:
        """Whether rows wait to be indexed: never, for exact search reads the rows themselves."""
        self.catalog.get(name)
        return False

    # Snapshots

    def save(self, name: str, path: str) -> None:
        """Copy the table to `path`/name. An older snapshot there stands until the new one is complete."""
        t = self.catalog.get(name)
        with self._timed("Save", "snapshot"):
            target = Catalog.__new__(Catalog)
            target.spark, target.storage, target.tables = self.spark, Storage(self.spark, path), {}
            copy = Table(t.name, t.schema, t.segmentation, t.indexes, t.limit, t.max_threads, f".{name}.new")
            target.storage.delete(copy.folder)
            layers = [target.write(copy, self.catalog.read(t).drop(BUCKET))] if t.layers else []
            target.commit(copy, layers)
            backup = f".{name}.backup"
            target.storage.delete(backup)
            if target.storage.exists(name):
                target.storage.rename(name, backup)
            target.storage.rename(copy.folder, name)
            target.storage.delete(backup)

    def load(self, name: str, path: str) -> None:
        """Bring a saved table in; one of that name must not be there."""
        if name in self.catalog.tables:
            raise EngineError(f"Table '{name}' already exists.")
        with self._timed("Load", "snapshot"):
            source = Catalog.__new__(Catalog)
            source.spark, source.storage, source.tables = self.spark, Storage(self.spark, path), {}
            saved = source.open(name) or source.open(f".{name}.backup")
            if saved is None:
                raise EngineError(f"There is no snapshot of '{name}' in {path}.")
            t = Table(saved.name, saved.schema, saved.segmentation, saved.indexes, saved.limit, saved.max_threads, saved.name)
            self.catalog.storage.delete(t.folder)
            self.catalog.commit(t, [self.catalog.write(t, source.read(saved).drop(BUCKET))] if saved.layers else [])
            self.catalog.tables[t.name] = t

    def unload(self, name: str, path: str) -> None:
        self.save(name, path)
        self.drop(name)

    def save_all(self, path: str) -> None:
        for n in self.list_tables():
            self.save(n, path)

    def load_all(self, path: str) -> None:
        for n in Storage(self.spark, path).names():
            if not n.startswith("."):
                self.load(n, path)

    # Administration

    def metrics_report(self) -> str:
        lines = ["| metric | count | seconds |", "| --- | --- | --- |"]
        return "\n".join(lines + [f"| {k} | {int(n)} | {s:.3f} |" for k, (n, s) in sorted(self.metrics.items())])

    def clear_metrics(self) -> None:
        self.metrics.clear()

    def config(self, action: str, name: str, value: str | None = None) -> dict[str, int]:
        """get or set a setting: active-set-size-limit (of tables to come), cursor-ttl (seconds)."""
        if name not in self.settings or action not in ("get", "set"):
            raise EngineError(f"Unknown setting: {name}")
        if action == "set":
            if value is None or not value.isdigit() or int(value) < 1:
                raise EngineError(f"{name} must be a positive integer, not {value!r}")
            self.settings[name] = int(value)
            self.cursors.ttl = self.settings["cursor-ttl"]
        return {name: self.settings[name]}

    def system_log(self, action: str, topic: str | None = None) -> list[str]:
        """set, reset or list the topics that are logged."""
        if topic is not None and topic not in LOG_TOPICS:
            raise EngineError(f"Unknown log topic: {topic}")
        if action == "set":
            self.topics |= {topic} if topic else set(LOG_TOPICS)
        elif action == "reset":
            self.topics -= {topic} if topic else set(LOG_TOPICS)
        elif action == "test":
            self.logs[topic or LOG_TOPICS[0]].info("test")
        elif action != "enabled":
            raise EngineError(f"Unknown action: {action}")
        return sorted(self.topics)


def _plain(value: object) -> object:
    return value if isinstance(value, bool | int | float | str) else str(value)


__all__ = ["ColumnNotFound", "Engine", "EngineError"]
