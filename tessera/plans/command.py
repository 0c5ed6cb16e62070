"""The command surface: lists of words in, results out."""

from __future__ import annotations

import io
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import types as T

from tessera.engine import Engine
from tessera.errors import EngineError
from tessera.sources.rows import _spark_types, to_ipc


def schema_from_ipc(data: bytes) -> tuple[T.StructType, dict[str, str]]:
    """A table's schema and metadata from an Arrow schema message."""
    from pyspark.sql.pandas.types import from_arrow_schema

    arrow = pa.ipc.read_schema(pa.BufferReader(data))
    wide = _spark_types(arrow.empty_table()).schema
    out = []
    for f, s in zip(arrow, from_arrow_schema(wide).fields, strict=True):
        meta = {}
        inner = f.type.value_type if pa.types.is_list(f.type) or pa.types.is_fixed_size_list(f.type) or pa.types.is_large_list(f.type) else f.type
        if pa.types.is_fixed_size_list(f.type):
            meta["list_size"] = f.type.list_size
        if pa.types.is_unsigned_integer(inner):
            meta["unsigned"] = inner.bit_width
        if f.metadata and b"primary_key" in f.metadata:
            meta["primary_key"] = True
        out.append(T.StructField(f.name, s.dataType, f.nullable, meta))
    return T.StructType(out), {k.decode(): v.decode() for k, v in (arrow.metadata or {}).items()}


def execute(engine: Engine, *words: str | bytes) -> object:
    """Run one command. Results that are rows come as Arrow IPC streams; the words are those of the command family
    TABLE (CREATE DROP LIST DESCRIBE INSERT BATCHINSERT SCAN SCANOPEN FETCHNEXT DEBUGSCAN ANN BATCHANN DELETE UPDATE
    COUNTRECORDS COUNTINDEXEDELEMENTS TOTALRECORDCOUNT TOTALTABLECOUNT CHECKINDEXING SEGMENTSTATISTICS), SAVE, LOAD and
    UNLOAD of a table, SAVE and LOAD of all, PING, INFO, CONFIG GET and SET, FLUSHALL, METRICS and SYSTEMLOG."""
    args = list(words)
    text = lambda x: x.decode() if isinstance(x, bytes) else x
    if not args:
        raise EngineError("No command given.")
    head = text(args.pop(0)).upper()
    if head in ("VDB-SAVE", "VDB-LOAD", "VDB-UNLOAD") or (head in ("SAVE", "LOAD", "UNLOAD") and len(args) == 2):
        _need(args, 2, 2, head)
        getattr(engine, head.removeprefix("VDB-").lower())(text(args[0]), text(args[1]))
        return "OK"
    if head in ("SAVE", "BGSAVE", "LOAD"):  # all tables; a save is done when it returns
        _need(args, 1, 1, head)
        (engine.load_all if head == "LOAD" else engine.save_all)(text(args[0]))
        return "OK"
    if head == "PING":
        return text(args[0]) if args else "PONG"
    if head == "FLUSHALL":
        for name in engine.list_tables():
            engine.drop(name)
        return "OK"
    if head == "INFO":
        total, deleted = engine.total_record_count()
        return {"tables": len(engine.list_tables()), "records": total, "deleted_records": deleted, "open_cursors": len(engine.cursors.open_cursors)}
    if head == "CONFIG":
        _need(args, 2, 3, head)
        return engine.config(text(args[0]).lower(), text(args[1]), text(args[2]) if len(args) > 2 else None)
    if head == "METRICS":
        _need(args, 1, 1, head)
        if text(args[0]).upper() == "CLEAR":
            engine.clear_metrics()
            return "OK"
        return engine.metrics_report()
    if head == "SYSTEMLOG":
        _need(args, 1, 2, head)
        return engine.system_log(*[text(a).lower() for a in args])
    if head != "TABLE" or not args:
        raise EngineError(f"Unknown command: {head}")
    verb = text(args.pop(0)).upper()
    if verb == "CREATE":
        _need(args, 1, 1, verb)
        schema, metadata = schema_from_ipc(args[0])
        engine.catalog.create(schema, metadata)
        return "OK"
    if verb == "LIST":
        return engine.list_tables()
    if verb == "TOTALRECORDCOUNT":
        return engine.total_record_count()
    if verb == "TOTALTABLECOUNT":
        return engine.total_table_count()
    if verb == "SEGMENTSTATISTICS":
        _need(args, 0, 1, verb)
        return engine.segment_statistics(*map(text, args))
    if verb == "FETCHNEXT":
        _need(args, 1, 1, verb)
        return _page(*engine.fetch_next(text(args[0])))
    if verb in ("SCANOPEN", "SCANOPEN_INTERNAL"):
        _need(args, 4, 5, verb)
        uuid, name, projection, condition, *limit = map(text, args)
        return _page(*engine.scan_open(uuid, name, projection, condition, _number(limit[0]) if limit else 0, verb.endswith("INTERNAL")))
    if not args:
        raise EngineError(f"TABLE {verb} needs a table.")
    name = text(args.pop(0))
    if verb == "DROP":
        engine.drop(name)
        return "OK"
    if verb in ("DESCRIBE", "DESCRIBE_INTERNAL"):
        return engine.describe(name, verb.endswith("INTERNAL"))
    if verb == "INSERT":
        _need(args, 1, 1, verb)
        engine.insert_text(name, text(args[0]))
        return "OK"
    if verb == "BATCHINSERT":
        _need(args, 1, 1, verb)
        return engine.insert(name, args[0])
    if verb in ("SCAN", "SCAN_INTERNAL"):
        _need(args, 2, 3, verb)
        projection, condition, *limit = map(text, args)
        return to_ipc(engine.scan(name, projection, condition, _number(limit[0]) if limit else 0, verb.endswith("INTERNAL")))
    if verb == "DEBUGSCAN":
        _need(args, 2, 2, verb)
        return engine.debug_scan(name, *map(text, args))
    if verb in ("ANN", "BATCHANN"):
        _need(args, 3, 6, verb)
        column, k, query, *rest = args
        ef = _number(text(rest[0])) if rest else None
        projection, condition = (text(rest[i]) if len(rest) > i else d for i, d in ((1, "*"), (2, "")))
        if verb == "ANN":
            if len(query) % 4:
                raise EngineError("The query is no list of float32 numbers.")
            return to_ipc(engine.ann(name, text(column), _number(text(k)), np.frombuffer(query, "<f4").tolist(), ef, projection, condition))
        got = pa.ipc.open_stream(io.BytesIO(query)).read_all()
        if "query" not in got.column_names:
            raise EngineError("Queries need a column named 'query'.")
        vectors = got["query"].to_pylist()
        found = engine.batch_ann(name, text(column), _number(text(k)), vectors, ef, projection, condition)
        result = found.toArrow()  # in order of the queries, each nearest first
        ends = np.searchsorted(result["query_idx"].to_numpy(), np.arange(len(vectors) + 1)).tolist()
        result = result.drop_columns(["query_idx"])
        return [_stream(result.slice(a, b - a)) for a, b in zip(ends, ends[1:])]
    if verb == "DELETE":
        _need(args, 1, 1, verb)
        return engine.delete(name, text(args[0]))
    if verb == "UPDATE":
        _need(args, 2, 2, verb)
        return engine.update(name, text(args[0]), text(args[1]))
    if verb == "COUNTRECORDS":
        return engine.count_records(name)
    if verb == "COUNTINDEXEDELEMENTS":
        return engine.count_indexed_elements(name)
    if verb == "CHECKINDEXING":
        return engine.check_indexing(name)
    raise EngineError(f"Unknown command: TABLE {verb}")


def _need(args: list, low: int, high: int, what: str) -> None:
    if not low <= len(args) <= high:
        raise EngineError(f"Wrong number of arguments for {what}.")


def _number(text: str) -> int:
    if not text.lstrip("-").isdigit():
        raise EngineError(f"Not a number: {text!r}")
    return int(text)


def _stream(table: pa.Table) -> bytes:
    out = io.BytesIO()
    with pa.ipc.new_stream(out, table.schema) as writer:
        writer.write_table(table)
    return out.getvalue()


def _page(table: pa.Table, more: bool) -> tuple[bytes, bool]:
    return _stream(table), more


def metadata_json(segmentation: dict | None = None, indexes: list | None = None) -> dict[str, str]:
    """Metadata of a schema message, from plain values."""
    return ({"segmentation_info": json.dumps(segmentation)} if segmentation else {}) | ({"index_info": json.dumps(indexes)} if indexes else {})
