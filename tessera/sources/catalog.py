"""Table definitions and where their rows are.

A table is a folder with layers of Parquet files and numbered manifests. The newest manifest says which layers count and
which segments of an older layer a newer one replaces, so a statement is one new manifest: readers see all of it or none.
One writer at a time is assumed for a table; a second one that races finds its manifest number taken and fails.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.errors import ColumnNotFound, EngineError
from tessera.functions.distance import SPACES
from tessera.sources.segment import BUCKET, Segmentation
from tessera.sources.storage import Storage
from tessera.types import DELETED, check_schema, extended, parse_schema

METADATA = {"table name", "segmentation_info", "index_info", "active_set_size_limit", "max_threads"}
ACTIVE_SET_SIZE_LIMIT = 10_000
#: Replaced segments that a manifest lists; a statement that touches more rewrites the table.
SEGMENTS_LISTED = 1000
#: Rows of a file at most, and layers after which an insert rewrites the table as one.
FILE_ROWS, LAYERS = 20_000_000, 64


def parse_index_info(text: str | list | None, schema: T.StructType) -> dict[str, dict]:
    """By column: the parameters of its vector index."""
    if not text:
        return {}
    entries = json.loads(text) if isinstance(text, str) else text
    out: dict[str, dict] = {}
    for e in entries:
        at = str(e.get("column_id", ""))
        if not at.isdigit() or int(at) >= len(schema.fields):
            raise EngineError(f"Bad column_id in index_info: {at!r}")
        f = schema.fields[int(at)]
        if str(e.get("index_type", "")).lower() != "hnsw":
            raise EngineError(f"Unsupported index type: {e.get('index_type')!r}")
        if not (isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.FloatType) and f.metadata.get("list_size")):
            raise EngineError(f"Column '{f.name}' can't be indexed: it must be a fixed-size list of float32.")
        if f.name in out:
            raise EngineError(f"Column '{f.name}' is indexed twice.")
        p = dict(e.get("parameters") or {})
        if unknown := set(p) - {"space", "M", "ef_construction"}:
            raise EngineError(f"Unknown index parameters: {sorted(unknown)}")
        if str(p.get("space", "")).lower() not in SPACES:
            raise EngineError(f"Unsupported space: {p.get('space')!r}")
        for n in ("M", "ef_construction"):
            if n in p and (not str(p[n]).isdigit() or int(p[n]) < 1):
                raise EngineError(f"{n} must be a positive integer.")
        out[f.name] = {"column_id": int(at), "metric": SPACES[str(p["space"]).lower()]} | {n: int(p[n]) for n in ("M", "ef_construction") if n in p}
    return out


@dataclass
class Table:
    name: str
    schema: T.StructType
    segmentation: Segmentation = field(default_factory=Segmentation)
    indexes: dict[str, dict] = field(default_factory=dict)
    limit: int = ACTIVE_SET_SIZE_LIMIT
    max_threads: int | None = None
    folder: str = ""
    version: int = 0
    layers: list[dict] = field(default_factory=list)
    streams: dict[str, int] = field(default_factory=dict)

    @property
    def primary_key(self) -> str | None:
        return next((f.name for f in self.schema.fields if f.metadata.get("primary_key")), None)

    def manifest(self) -> str:
        return json.dumps({"name": self.name, "schema": self.schema.jsonValue(), "segmentation": self.segmentation.json(), "indexes": self.indexes, "limit": self.limit, "max_threads": self.max_threads, "layers": self.layers, "streams": self.streams})

    @classmethod
    def load(cls, text: str, folder: str, version: int) -> Table:
        m = json.loads(text)
        schema = T.StructType.fromJson(m["schema"])
        return cls(m["name"], schema, Segmentation.parse(m["segmentation"], schema), m["indexes"], m["limit"], m["max_threads"], folder, version, m["layers"], m.get("streams", {}))


class Catalog:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.storage = spark, Storage(spark, root)
        self.tables: dict[str, Table] = {}
        for name in self.storage.names():
            if not name.startswith(".") and (table := self.open(name)):
                self.tables[table.name] = table

    def open(self, folder: str, storage: Storage | None = None) -> Table | None:
        """The newest state of a table's folder."""
        storage = storage or self.storage
        versions = [int(n[:-5]) for n in storage.names(folder, "manifest") if n.endswith(".json") and n[:-5].isdigit()]
        return Table.load(storage.read(folder, "manifest", f"{max(versions)}.json"), folder, max(versions)) if versions else None

    def get(self, name: str) -> Table:
        if name not in self.tables:
            raise EngineError(f"Table '{name}' does not exist.")
        return self.tables[name]

    def names(self) -> list[str]:
        return sorted(self.tables)

    def create(self, schema: str | T.StructType, metadata: dict[str, object]) -> Table:
        """Validate and register a table; metadata has 'table name' and may have the other known keys."""
        if unknown := set(metadata) - METADATA:
            raise EngineError(f"Unknown metadata: {sorted(unknown)}")
        name = metadata.get("table name")
        if not isinstance(name, str) or not name or any(c.isspace() for c in name) or "/" in name or name.startswith("."):
            raise EngineError(f"Bad table name: {name!r}")
        if name in self.tables:
            raise EngineError(f"Table '{name}' already exists.")
        schema = parse_schema(schema) if isinstance(schema, str) else schema
        check_schema(schema)

        def positive(key: str, default: int | None) -> int | None:
            value = metadata.get(key, default)
            if value is not None and (not str(value).isdigit() or int(value) < 1):
                raise EngineError(f"{key} must be a positive integer, not {value!r}")
            return None if value is None else int(value)

        table = Table(name, schema, Segmentation.parse(metadata.get("segmentation_info"), schema), parse_index_info(metadata.get("index_info"), schema), positive("active_set_size_limit", ACTIVE_SET_SIZE_LIMIT), positive("max_threads", None), name)
        self.commit(table, [])
        self.tables[name] = table
        return table

    def commit(self, table: Table, layers: list[dict]) -> None:
        before = table.layers, table.version
        table.layers, table.version = layers, table.version + 1
        try:
            self.storage.write(table.manifest(), table.folder, "manifest", f"{table.version}.json")
        except Exception:
            table.layers, table.version = before
            raise

    def drop(self, name: str) -> None:
        table = self.get(name)
        del self.tables[name]
        self.storage.delete(table.folder)

    def read(self, table: Table) -> DataFrame:
        """All rows with the deletion flag, and the bucket of hash segmentation."""
        full = extended(table.schema)
        bucketed = T.StructType([*full.fields, *([T.StructField(BUCKET, T.IntegerType())] if table.segmentation.kind == "hash" else [])])
        out = None
        for layer in table.layers:
            df = self.spark.read.schema(bucketed).parquet(f"{self.storage.root}/{table.folder}/{layer['path']}").select(*[F.col(f"`{c}`") for c in bucketed.names])
            if layer["minus"]:
                df = df.where(~self._in_segments(table, layer["minus"]))
            out = df if out is None else out.unionByName(df)
        return out if out is not None else self.spark.createDataFrame([], bucketed)

    @staticmethod
    def _in_segments(table: Table, segments: list[list]):
        """Whether a row is in one of the segments, given by the values of its partition columns."""
        kinds = [T.IntegerType() if c == BUCKET else table.schema[c].dataType for c in table.segmentation.columns()]
        cols = [F.col(f"`{c}`") for c in table.segmentation.columns()]
        if len(cols) == 1:
            return cols[0].isin(*[F.lit(s[0]).cast(kinds[0]) for s in segments])
        out = F.lit(False)
        for s in segments:
            one = F.lit(True)
            for c, v, k in zip(cols, s, kinds, strict=True):
                one = one & (c == F.lit(v).cast(k))
            out = out | one
        return out

    def write(self, table: Table, df: DataFrame) -> dict:
        """A new layer with the rows (user columns and deletion flag); not yet part of the table."""
        seg = table.segmentation
        df = df.select(*table.schema.names, DELETED)
        if seg.kind == "hash":
            df = df.withColumn(BUCKET, seg.bucket(F.col(f"`{seg.keys[0]}`")))
        path = f"layers/{uuid.uuid4().hex}"
        if seg.kind:  # rows of a segment together, and a large segment in several tasks
            df = df.hint("rebalance", *seg.columns())
        writer = df.write.option("maxRecordsPerFile", FILE_ROWS)
        (writer.partitionBy(*seg.columns()) if seg.kind else writer).parquet(f"{self.storage.root}/{table.folder}/{path}")
        return {"path": path, "minus": []}

    def replace(self, table: Table, touched: list[list] | None, layer: dict) -> None:
        """Make `layer` stand for the touched segments; None: for the whole table."""
        if touched is None or not table.segmentation.kind:
            self.commit(table, [layer])
            return
        old = [{"path": x["path"], "minus": [*x["minus"], *[s for s in touched if s not in x["minus"]]]} for x in table.layers]
        if any(len(x["minus"]) > SEGMENTS_LISTED for x in old):
            raise EngineError("too many segments to list")
        self.commit(table, [*old, layer])

    def vacuum(self, table: Table) -> int:
        """Delete the layers and manifests that the newest manifest doesn't need; how many layers. Frames read before must not be used any more."""
        used = {x["path"].split("/")[-1] for x in table.layers}
        old = [n for n in self.storage.names(table.folder, "layers") if n not in used]
        for n in old:
            self.storage.delete(table.folder, "layers", n)
        for n in self.storage.names(table.folder, "manifest"):
            if n.endswith(".json") and n != f"{table.version}.json":
                self.storage.delete(table.folder, "manifest", n)
        return len(old)

    def vector_column(self, table: Table, column: str) -> dict:
        if column not in table.schema.names:
            raise ColumnNotFound(column)
        if column not in table.indexes:
            raise EngineError("Table does not support ann.")
        return table.indexes[column]
