import json

import numpy as np
import pyarrow as pa
import pytest

from tessera.engine import Engine
from tessera.errors import ColumnNotFound, EngineError
from tessera.operators.ann import build_ivf, open_ivf
from tessera.operators.cursor import CursorRegistry
from tessera.operators.knn import exact_ids, knn_batch
from tessera.plans.command import execute, metadata_json
from tessera.sources.segment import hash_id, parse_id, value_id

BY_ID = {"segment_type": "value", "segment_keys": ["id"], "segment_key_composition_type": "single"}
INDEX = [{"column_id": "2", "index_type": "Hnsw", "parameters": {"space": "L2Space", "ef_construction": "100", "M": "2"}}]
CREW = [(i, n, ",".join(f"tool {i * k % 5}" for k in range(1, i + 2))) for i, n in enumerate(("Ada", "Bo", "Ada", "Cy"))]


@pytest.fixture
def engine(spark, tmp_path):
    return Engine(spark, str(tmp_path / "engine"))


def crew(engine):
    engine.create("Id uint32 not null, name string, tools list[string]", "crew", segmentation_info=BY_ID)
    rows = engine.spark.createDataFrame([(i, n, a.split(",")) for i, n, a in CREW], "id long, name string, tools array<string>")
    engine.insert("crew", rows)


def vectors(engine, rows):
    engine.create("ID uint32 not null, name string, spot fixed_size_list[3, float32]", "v", index_info=INDEX)
    engine.insert("v", engine.spark.createDataFrame([(i, n, list(map(float, f))) for i, n, f in rows], "id long, name string, spot array<float>"))


def test_text_rows(engine):
    engine.create("Id uint32 not null, name string, tools list[string]", "t")
    engine.insert_text("t", "7\x1eAda\x1esaw\x1dfile")
    engine.insert_text("t", "8\x1e\x1e")
    assert sorted(map(tuple, engine.scan("t").collect())) == [(7, "Ada", ["saw", "file"]), (8, "", [])]
    for bad in ("7\x1eAda", "7\x1eAda\x1ex\x1ey", "x\x1eAda\x1e", "-1\x1eAda\x1e", "4294967296\x1eJ\x1e"):
        with pytest.raises(Exception):
            engine.insert_text("t", bad)
    assert engine.count_records("t") == 2


def test_delete(engine):
    crew(engine)
    assert engine.scan("crew", "*", "id < 4").count() == 4
    assert engine.delete("crew", "id < 2") == 2
    assert engine.count_records("crew") == 2
    assert engine.delete("crew", "id = 3") == 1
    assert engine.delete("crew", "id = 3") == 0
    assert engine.count_records("crew") == 1
    got = json.loads(engine.segment_statistics("crew"))["segment_statistics"]
    assert len(got) == 4 and sum(s["row_count"] for s in got) == 4 and sum(s["deleted_row_count"] for s in got) == 3


def test_update_moves_rows(engine):
    crew(engine)
    engine.delete("crew", "id = 0")
    assert engine.update("crew", "id = 9, name = 'a, b'", "id = 2") == 1
    assert engine.count_records("crew") == 3
    assert sorted(map(tuple, engine.scan("crew", "id, name", "id > 1").collect())) == [(3, "Cy"), (9, "a, b")]
    assert engine.update("crew", "name = 'x'", "id = 77") == 0
    with pytest.raises(ColumnNotFound):
        engine.update("crew", "nope = 1", "")
    with pytest.raises(EngineError):
        engine.update("crew", "id = 5'", "")


def test_scan_limits_and_internal(engine):
    crew(engine)
    engine.delete("crew", "id = 1")
    assert engine.scan("crew", "*", "", 0).count() == 3
    assert engine.scan("crew", "*", "", 2).count() == 2
    assert engine.scan("crew", "id, __deleted_flag", "", internal=True).columns == ["id", "__deleted_flag"]
    assert engine.scan("crew", "name", "", internal=True).columns == ["name"]
    assert engine.scan("crew", "*", "__deleted_flag = true", internal=True).count() == 1
    assert engine.scan("crew", "*", "__deleted_flag = false", internal=True).count() == 3
    for filter_text in ("__deleted_flag = true", "nope = 1"):
        with pytest.raises(ColumnNotFound):
            engine.scan("crew", "*", filter_text)
    with pytest.raises(ColumnNotFound):
        engine.scan("crew", "__deleted_flag")
    assert "Cy" in engine.debug_scan("crew", "name", "id = 3")


def test_partition_pruning(engine):
    crew(engine)
    plan = engine.scan("crew", "name", "id = 2")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "(id#" in plan.split("PartitionFilters: ")[1].split("]")[0]
    engine.create("ID uint32 not null, Name String", "h", segmentation_info={"segment_type": "hash", "segment_keys": ["id"], "segment_key_composition_type": "single", "num_buckets": 5})
    engine.insert("h", engine.spark.createDataFrame([(i, str(i)) for i in range(20)], "id long, name string"))
    df = engine.scan("h", "name", "id = 2")
    assert df.collect()[0].name == "2" and "__bucket" in df._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: ")[1].split("]")[0]
    assert engine.delete("h", "id IN (3, 4)") == 2 and engine.count_records("h") == 18


def test_search(engine):
    vectors(engine, [(0, "Ada", (4.5, 0.25, -1.5)), (1, "Bo", (-2.5, 6.0, 3.5))])
    got = engine.ann("v", "spot", 2, [4, 0, -1], projection="distance, name, id")
    assert got.columns == ["distance", "name", "id"] and got.schema["distance"].dataType.simpleString() == "float"
    assert [r.id for r in got.collect()] == [0, 1]
    assert engine.ann("v", "spot", 1, [4, 0, -1]).columns == ["id", "name", "spot", "distance"]
    assert engine.ann("v", "spot", 5, [-2, 6, 3]).count() == 2
    assert [r.id for r in engine.ann("v", "spot", 5, [-2, 6, 3], filter_text="id < 1").collect()] == [0]
    empty = engine.ann("v", "spot", 5, [-2, 6, 3], filter_text="id < 0", projection="id, distance")
    assert empty.count() == 0 and empty.columns == ["id", "distance"]
    for bad in (lambda: engine.ann("v", "spot", 0, [1, 2, 3]), lambda: engine.ann("v", "spot", 1, [1, 2]), lambda: engine.ann("v", "name", 1, [1, 2, 3]), lambda: engine.ann("v", "spot", 1, [1, 2, 3], ef=0)):
        with pytest.raises(EngineError):
            bad()


def test_search_after_changes(engine):
    vectors(engine, [(0, "a", (0.5, 0.5, 0.0)), (1, "b", (1.5, 1.0, 0.5)), (2, "c", (4.0, -3.0, 2.0))])
    near = lambda: {r.id for r in engine.ann("v", "spot", 2, [0, 1, 0]).collect()}
    assert near() == {0, 1}
    assert engine.update("v", "spot = [90.0, -80.0, 70.0]", "id = 1") == 1
    assert near() == {0, 2}
    assert engine.delete("v", "id = 2") == 1
    assert near() == {0, 1}


def test_batch_search(engine):
    r = np.random.default_rng(11)
    rows, asked = r.normal(size=(40, 3)).round(3), r.normal(size=(5, 3)).round(3)
    vectors(engine, [(i, "x", f) for i, f in enumerate(rows.tolist())])
    got = engine.batch_ann("v", "spot", 4, asked.tolist(), ef=6, projection="id").collect()
    order = ((rows[None].astype("f4") - asked[:, None]) ** 2).sum(2).argsort(axis=1)[:, :4]
    assert [(x.query_idx, x.id) for x in got] == [(q, i) for q, own in enumerate(order.tolist()) for i in own]


def test_rows_are_found_by_record(engine):
    """Labels repeat, and another table has no integer column at all."""
    engine.create("tag int32, spot fixed_size_list[2, float32]", "tags", index_info=[{**INDEX[0], "column_id": "1"}])
    rows = [(1, [0.0, 0.0]), (1, [9.0, 9.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (None, [0.0, 1.0])]
    engine.insert("tags", engine.spark.createDataFrame(rows, "tag int, spot array<float>"))
    got = engine.ann("tags", "spot", 3, [0, 0], projection="tag, distance").collect()
    assert [(r.tag, r.distance) for r in got] == [(1, 0.0), (2, 1.0), (2, 1.0)]
    engine.create("word string, spot fixed_size_list[2, float32]", "words", index_info=[{**INDEX[0], "column_id": "1"}])
    engine.insert("words", engine.spark.createDataFrame([("a", [0.0, 2.0]), ("b", [0.0, 1.0]), ("b", [0.0, 1.0])], "word string, spot array<float>"))
    assert [r.word for r in engine.ann("words", "spot", 9, [0, 0], projection="word").collect()] == ["b", "b", "a"]


def test_layers_go(engine):
    crew(engine)
    engine.delete("crew", "id = 2")
    engine.compact("crew")
    assert engine.vacuum("crew") >= 2 and engine.vacuum("crew") == 0
    assert engine.count_records("crew") == 3
    assert Engine(engine.spark, engine.catalog.storage.root).count_records("crew") == 3


def test_a_batch_of_a_stream_comes_once(engine):
    crew(engine)
    more = engine.spark.createDataFrame([(9, "Di", ["saw"])], "id long, name string, tools array<string>")
    assert [engine.insert("crew", more, stream=("s", n)) for n in (0, 0, 1)] == [1, 0, 1]
    assert engine.count_records("crew") == 6


def test_batch_is_union_of_singles_and_nested(spark):
    r = np.random.default_rng(0)
    df = spark.createDataFrame([(i, r.normal(size=8).tolist()) for i in range(300)] + [(1000, None), (None, [0.0] * 8), (1001, [1.0])], "id long, v array<double>")
    queries = r.normal(size=(5, 8)).tolist()
    for metric in ("l2", "ip", "cosine"):
        five = exact_ids(spark, df, "v", "id", queries, 5, metric)
        six = exact_ids(spark, df, "v", "id", queries, 6, metric)
        assert all(a < b for a, b in zip(five, six, strict=True))
        assert five == [exact_ids(spark, df, "v", "id", [q], 5, metric)[0] for q in queries]
    ties = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(9, -1, -1)], "id long, v array<double>")
    assert exact_ids(spark, ties, "v", "id", [[0.0, 0.0]], 3, "l2") == [{0, 1, 2}]
    assert knn_batch(ties, "v", "id", [], 3).count() == 0


@pytest.mark.parametrize("metric", ["l2", "ip"])
def test_recall(spark, tmp_path, metric):
    r = np.random.default_rng(1)
    data = r.uniform(-1, 1, (1000, 16))
    data = data / np.linalg.norm(data, axis=1, keepdims=True) if metric == "ip" else data
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "id long, v array<float>")
    build_ivf(df, "v", "id", metric, str(tmp_path / "ivf"))
    index = open_ivf(spark, str(tmp_path / "ivf"))
    queries = data[:40]
    truth = exact_ids(spark, df, "v", "id", queries.tolist(), 10, metric)

    def recall(nprobe):
        got = [set() for _ in queries]
        for row in index.search(spark, queries, 10, nprobe).collect():
            got[row.query_idx].add(row.id)
        return sum(len(a & b) for a, b in zip(truth, got, strict=True)) / 400

    assert recall(len(index.centres)) == 1.0
    assert recall(len(index.centres) * 2 // 3) >= 0.9


def test_recall_of_the_approximate_command(engine):
    data = np.random.default_rng(2).uniform(-1, 1, (1000, 16))
    engine.create("ID uint32 not null, spot fixed_size_list[16, float32]", "a", index_info=[{**INDEX[0], "column_id": "1"}])
    df = engine.spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "id long, spot array<float>")
    engine.insert("a", df)
    engine.build_index("a", "spot", f"{engine.catalog.storage.root}/ivf")
    queries = data[:40].tolist()
    truth = exact_ids(engine.spark, df, "spot", "id", queries, 10, "l2")
    for ef in (None, 30, 1000):
        got = [set() for _ in queries]
        for row in engine.approximate_ann("a", "spot", 10, queries, ef).collect():
            got[row.query_idx].add(row.id)
        recall = sum(len(a & b) for a, b in zip(truth, got, strict=True)) / 400
        assert recall >= (1.0 if ef == 1000 else 0.9), ef


def test_primary_key(engine):
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("id", T.LongType(), False), T.StructField("pk", T.StringType(), True, {"primary_key": True})])
    engine.create(schema, "keyed")
    rows = lambda a, b: engine.spark.createDataFrame([(i, f"file\x1e{i}") for i in range(a, b)], "x long, y string")
    assert engine.insert("keyed", rows(0, 100)) == 100
    assert engine.insert("keyed", rows(0, 100)) == 0
    assert engine.insert("keyed", rows(50, 150)) == 50
    with pytest.raises(EngineError):
        engine.insert("keyed", rows(200, 210).union(rows(205, 206)))
    assert engine.delete("keyed", "id = 5") == 1
    assert engine.insert("keyed", rows(5, 6)) == 1
    with pytest.raises(EngineError):
        engine.update("keyed", "pk = 'file\x1e1'", "id = 9")
    assert engine.count_records("keyed") == 150


def test_insert_checks(engine):
    crew(engine)
    spark = engine.spark
    for df in (spark.createDataFrame([(1,)], "a long"), spark.createDataFrame([("1", "x", ["y"])], "a string, b string, c array<string>"), spark.createDataFrame([(None, "x", ["y"])], "a long, b string, c array<string>"), spark.createDataFrame([(-5, "x", ["y"])], "a long, b string, c array<string>")):
        with pytest.raises(Exception):
            engine.insert("crew", df)
    assert engine.count_records("crew") == 4


def test_catalog_checks(engine):
    engine.create("a int32", "t")
    for schema, options in (("a int32", {"name": "t"}), ("a int32", {"name": "a b"}), ("__a int32", {"name": "x"}), ("a int32", {"name": "x", "wrong": 1}), ("a int32", {"name": "x", "active_set_size_limit": 0}), ("a int32", {"name": "x", "segmentation_info": BY_ID}), ("id int32", {"name": "x", "segmentation_info": BY_ID}), ("a int32", {"name": "x", "index_info": INDEX})):
        with pytest.raises(EngineError):
            engine.create(schema, **options)
    for wrong in ({"space": "cosine"}, {"space": "L2Space", "x": 1}, {"space": "L2Space", "M": "0"}):
        with pytest.raises(EngineError):
            engine.create("a int32, b int32, c fixed_size_list[3, float32]", "x", index_info=[INDEX[0] | {"parameters": wrong}])
    assert engine.list_tables() == ["t"]
    assert Engine(engine.spark, engine.catalog.storage.root).list_tables() == ["t"]
    engine.drop("t")
    with pytest.raises(EngineError):
        engine.drop("t")
    assert engine.list_tables() == [] and engine.total_record_count() == (0, 0)


def test_segment_ids(engine):
    assert value_id("composite", ["region", "date", "category"], ["seoul", "2024-01-01", "electronics"]) == 'v1::value::comp::region+date+category::["seoul","2024-01-01","electronics"]::::'
    assert hash_id("id", "123", 10) == "v1::hash::single::id::8::10::"
    assert parse_id('v1::value::single::k::["a::b"]::::')["values"] == ["a::b"]
    assert parse_id("v1::hash::single::id::8::10::")["bucket"] == 8
    assert parse_id("_default_")["type"] == "default"
    for bad in ("", "v2::hash::single::id::8::10::", "v1::value::single::k::[::::", "v1::value::comp::a+b::[\"x\"]::::"):
        with pytest.raises(EngineError):
            parse_id(bad)


def test_cursor(spark):
    now = [0.0]
    cursors = CursorRegistry(ttl=10, clock=lambda: now[0])
    df = spark.range(7)
    page, more = cursors.open("u", df, 3)
    assert page.num_rows == 3 and more
    with pytest.raises(EngineError):
        cursors.open("u", df, 3)
    assert cursors.fetch("u")[0].num_rows == 3
    page, more = cursors.fetch("u")
    assert page.num_rows == 1 and not more
    with pytest.raises(EngineError):
        cursors.fetch("u")
    assert cursors.open("e", df.limit(0), 3) [1] is False
    cursors.open("old", df, 3)
    now[0] = 11
    assert cursors.sweep() == 1
    with pytest.raises(EngineError):
        cursors.fetch("old")


def test_snapshot(engine, tmp_path):
    crew(engine)
    engine.delete("crew", "id = 1")
    path = str(tmp_path / "snap")
    engine.save("crew", path)
    engine.save("crew", path)
    before = sorted(map(tuple, engine.scan("crew").collect()))
    with pytest.raises(EngineError):
        engine.load("crew", path)
    engine.unload("crew", path)
    assert engine.list_tables() == []
    engine.load_all(path)
    assert sorted(map(tuple, engine.scan("crew").collect())) == before
    assert engine.scan("crew", "*", "__deleted_flag = true", internal=True).count() == 1
    assert engine.describe("crew")["id"].metadata == {"unsigned": 32}
    engine.compact("crew")
    assert sorted(map(tuple, engine.scan("crew").collect())) == before
    with pytest.raises(EngineError):
        engine.load("nope", path)


def test_commands(engine):
    schema = pa.schema([pa.field("id", pa.uint32(), nullable=False), pa.field("name", pa.string()), pa.field("spot", pa.list_(pa.float32(), 3))], metadata={"table name": "t", **metadata_json(BY_ID, INDEX)})
    assert execute(engine, "TABLE", "CREATE", schema.serialize().to_pybytes()) == "OK"
    assert execute(engine, "table", "list") == ["t"]
    execute(engine, "TABLE", "INSERT", "t", "1\x1eA\x1e1\x1d2\x1d3")
    sink = pa.BufferOutputStream()
    table = pa.table({"x": pa.array([2, 3], pa.uint32()), "y": ["B", "C"], "z": pa.array([[4, 5, 6], [7, 8, 9]], pa.list_(pa.float32(), 3))})
    with pa.ipc.new_stream(sink, table.schema) as w:
        w.write_table(table)
    assert execute(engine, "TABLE", "BATCHINSERT", "t", sink.getvalue().to_pybytes()) == 2
    rows = pa.ipc.open_stream(execute(engine, "TABLE", "SCAN", "t", "name, id", "id >= 2", "0")).read_all().to_pylist()
    assert sorted(r["name"] for r in rows) == ["B", "C"]
    found = pa.ipc.open_stream(execute(engine, "TABLE", "ANN", "t", "spot", "1", np.array([4, 5, 6], "<f4").tobytes(), "5", "id, distance", "id < 3")).read_all().to_pylist()
    assert found == [{"id": 2, "distance": 0.0}]
    queries = pa.table({"query": pa.array([[1, 2, 3], [7, 8, 9]], pa.list_(pa.float32(), 3))})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, queries.schema) as w:
        w.write_table(queries)
    got = execute(engine, "TABLE", "BATCHANN", "t", "spot", "1", sink.getvalue().to_pybytes(), "1", "id")
    assert [pa.ipc.open_stream(g).read_all()["id"].to_pylist() for g in got] == [[1], [3]]
    page, more = execute(engine, "TABLE", "SCANOPEN", "u", "t", "id", "", "0")
    assert pa.ipc.open_stream(page).read_all().num_rows == 3 and not more
    assert execute(engine, "TABLE", "COUNTINDEXEDELEMENTS", "t") == (3, {"spot": ("Hnsw", 3)})
    assert execute(engine, "TABLE", "UPDATE", "t", "name = 'Z'", "id = 1") == 1
    assert execute(engine, "TABLE", "DELETE", "t", "id = 1") == 1
    assert execute(engine, "TABLE", "COUNTRECORDS", "t") == 2
    assert execute(engine, "TABLE", "TOTALRECORDCOUNT") == (4, 2) and execute(engine, "TABLE", "TOTALTABLECOUNT") == (1, 0)
    assert execute(engine, "TABLE", "CHECKINDEXING", "t") is False
    assert "segment_statistics" in execute(engine, "TABLE", "SEGMENTSTATISTICS", "t")
    assert "Scan" in execute(engine, "METRICS", "PRINT") and execute(engine, "METRICS", "CLEAR") == "OK"
    assert execute(engine, "SYSTEMLOG", "set", "scan") == ["scan"] and execute(engine, "SYSTEMLOG", "reset") == []
    assert execute(engine, "TABLE", "DESCRIBE", "t").names == ["id", "name", "spot"]
    assert execute(engine, "PING") == "PONG" and execute(engine, "INFO")["tables"] == 1
    assert execute(engine, "CONFIG", "SET", "active-set-size-limit", "7") == {"active-set-size-limit": 7} == execute(engine, "CONFIG", "GET", "active-set-size-limit")
    snapshot = engine.catalog.storage.root + "-all"
    assert execute(engine, "SAVE", snapshot) == "OK" and execute(engine, "FLUSHALL") == "OK" and execute(engine, "TABLE", "LIST") == []
    assert execute(engine, "LOAD", snapshot) == "OK" and execute(engine, "TABLE", "COUNTRECORDS", "t") == 2
    assert execute(engine, "TABLE", "DROP", "t") == "OK"
    for bad in ((), ("NOPE",), ("TABLE", "NOPE", "t"), ("TABLE", "SCAN", "t"), ("TABLE", "DROP", "t")):
        with pytest.raises(EngineError):
            execute(engine, *bad)
