"""The registered queries over the driver's tables."""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.engine import Engine
from tessera.errors import EngineError
from tessera.operators import stats
from tessera.operators.ann import build_ivf
from tessera.operators.cursor import CursorRegistry
from tessera.operators.knn import exact_ids, knn, knn_batch, with_distance, within
from tessera.operators.scan import scan
from tessera.sources.rows import from_ipc, to_ipc
from tessera.sources.scratch import scratch
from tessera.types import DELETED

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with their labels, where they have any: quality and toxic hold nulls."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    labels = read(spark, sf_dir, "labels").withColumn("grade", F.when(F.col("quality") == 1, "good").otherwise("bad"))
    return docs.join(labels, "doc_id", "left")


#: Scans: table, projection, filter. The oracle has the same names.
SCANS: dict[str, tuple[str, str, str]] = {
    "scan_star": ("nation", "*", ""),
    "scan_projection": ("customer", "c_custkey, c_name", ""),
    "scan_projection_reordered": ("customer", " c_name ,c_acctbal,, c_custkey", "c_custkey > 10"),
    "scan_empty_filter": ("region", "r_name", "  "),
    "filter_eq": ("lineitem", "l_orderkey, l_linenumber", "l_linenumber = 3"),
    "filter_ne": ("lineitem", "l_orderkey, l_linenumber", "l_linenumber != 3"),
    "filter_ne_alt": ("part", "p_partkey, p_size", "p_size <> 7"),
    "filter_lt": ("part", "p_partkey, p_retailprice", "p_retailprice < 950.5"),
    "filter_le": ("part", "p_partkey, p_size", "p_size <= 10"),
    "filter_gt": ("orders", "o_orderkey, o_totalprice", "o_totalprice > 200000"),
    "filter_ge": ("lineitem", "l_orderkey, l_linenumber, l_quantity", "l_quantity >= 49"),
    "filter_eq_string": ("customer", "c_custkey, c_mktsegment", "c_mktsegment = 'BUILDING'"),
    "filter_cmp_string": ("customer", "c_custkey, c_name", "c_name >= 'Customer#000000100' AND c_name < 'Customer#000000900'"),
    "filter_is_null": ("labelled", "doc_id", "quality IS NULL"),
    "filter_is_not_null": ("labelled", "doc_id, quality", "quality is not null"),
    "filter_in_int": ("labelled", "doc_id, quality", "quality IN (0, 5)"),
    "filter_in_string": ("labelled", "doc_id, grade", "grade in ('bad', 'null')"),
    "filter_not_in_keeps_null": ("labelled", "doc_id, quality", "quality NOT IN (1)"),
    "filter_in_null": ("labelled", "doc_id, quality", "quality IN (0, null)"),
    "filter_not_in_null": ("labelled", "doc_id, quality", "quality NOT IN (0, null)"),
    "filter_like_prefix": ("part", "p_partkey, p_type", "p_type LIKE 'S%'"),
    "filter_like_suffix": ("part", "p_partkey, p_brand", "p_brand LIKE '%3'"),
    "filter_like_contains": ("pages", "page_id", "url LIKE '%example.com%'"),
    "filter_like_underscore": ("part", "p_partkey, p_brand", "p_brand like 'Brand#_2'"),
    "filter_not_like": ("pages", "page_id", "url NOT LIKE 'https%'"),
    "filter_not_like_null": ("labelled", "doc_id, grade", "grade NOT LIKE 'b%'"),
    "filter_and": ("lineitem", "l_orderkey, l_linenumber", "l_quantity < 10 AND l_discount > 0.05 AND l_returnflag = 'R'"),
    "filter_or": ("lineitem", "l_orderkey, l_linenumber", "l_quantity < 2 OR l_quantity > 49"),
    "filter_not": ("lineitem", "l_orderkey, l_linenumber", "NOT l_returnflag = 'N'"),
    "filter_precedence": ("lineitem", "l_orderkey, l_linenumber", "l_linenumber = 1 OR l_linenumber = 2 AND NOT l_returnflag = 'N'"),
    "filter_nested": ("lineitem", "l_orderkey, l_linenumber", "(l_linenumber = 1 or (l_quantity > 40 and not (l_discount < 0.02 or l_tax >= 0.07))) aNd l_linestatus <> 'O'"),
    "filter_kleene_or_null": ("labelled", "doc_id", "quality = 1 OR lang = 'en'"),
    "filter_kleene_not_null": ("labelled", "doc_id", "NOT (quality = 1 AND lang = 'en')"),
}


def _scan(name: str) -> Query:
    table, projection, condition = SCANS[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return scan(labelled(spark, sf_dir) if table == "labelled" else read(spark, sf_dir, table), projection, condition)

    return run


QUERIES |= {name: _scan(name) for name in SCANS}


@query
def scan_limit_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "orders"), "o_orderkey", "o_totalprice > 1000", 250).agg(F.count("*").alias("n"))


@query
def scan_limit_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "orders"), "o_orderkey", "", 0).agg(F.count("*").alias("n"))


@query
def filter_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The canonical form of filters, and the columns they name."""
    from tessera.functions.filters import parse_filter

    schema = read(spark, sf_dir, "lineitem").schema
    rows = []
    for i, text in enumerate(["l_suppkey<40 or not l_linestatus   like '_O%' and l_orderkey IN(7,8 , 9)", "( ( l_linestatus IS NOT NULL ) )", "not (l_partkey >= 12 or l_partkey not in (3)) AND (l_returnflag is null or l_extendedprice <=100.5)"]):
        tree = parse_filter(text, schema)
        rows.append((i, str(tree), ",".join(tree.columns())))
    return spark.createDataFrame(rows, "i int, canonical string, columns string")


# Vectors

DIGITS = 5


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings with a factor that differs from row to row: the vectors as such are of unit length, where l2 and ip rank alike."""
    return read(spark, sf_dir, "embeddings").withColumn("scaled", F.transform("embedding", lambda x: x.cast("double") * (1 + F.col("vec_id") % 7)))


def vector(df: DataFrame, vec_id: int, column: str = "embedding") -> list[float]:
    row = df.where(F.col("vec_id") == vec_id).select(column).first()
    return list(row[0])


def _near(df: DataFrame, column: str, q: list[float], k: int, metric: str, projection: str = "vec_id, label, distance") -> DataFrame:
    return knn(df, column, "vec_id", q, k, metric, projection, DIGITS)


@query
def knn_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: the ten nearest vectors to vector 0 by l2 whose label isn't 3."""
    df = vectors(spark, sf_dir)
    return _near(scan(df, "*", "label != 3"), "embedding", vector(df, 0), 10, "l2")


def _single(metric: str, column: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = vectors(spark, sf_dir)
        return _near(df, column, vector(df, 0), 10, metric)

    return run


QUERIES |= {"knn_l2_single": _single("l2", "embedding"), "knn_ip_single": _single("ip", "embedding"), "knn_l2_scaled": _single("l2", "scaled"), "knn_ip_scaled": _single("ip", "scaled"), "knn_cosine": _single("cosine", "scaled")}


@query
def knn_projection_distance_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = vectors(spark, sf_dir)
    return _near(df, "embedding", vector(df, 5), 5, "l2", "distance, vec_id")


@query
def knn_without_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = vectors(spark, sf_dir)
    return _near(df, "embedding", vector(df, 5), 5, "ip", "label, vec_id")


@query
def knn_filtered_none(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = vectors(spark, sf_dir)
    return _near(scan(df, "*", "label = 77"), "embedding", vector(df, 0), 10, "l2")


@query
def knn_k_exceeds_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = vectors(spark, sf_dir)
    return _near(scan(df, "*", "vec_id < 20"), "embedding", vector(df, 0), 100, "l2")


@query
def knn_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = vectors(spark, sf_dir)
    return within(df, "embedding", vector(df, 0), 1.7).select("vec_id", F.round("distance", DIGITS).alias("distance"))


@query
def knn_all_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = vectors(spark, sf_dir)
    return with_distance(df, "scaled", vector(df, 3, "scaled"), "ip").select("vec_id", F.round("distance", DIGITS).alias("distance"))


def _batch(metric: str, column: str, which: str, condition: str = "") -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = vectors(spark, sf_dir)
        queries = df.where(which).select("vec_id", F.col("embedding").alias("query"))
        return knn_batch(scan(df, "*", condition), column, "vec_id", queries, 5, metric, "vec_id, distance", DIGITS, query_key="vec_id")

    return run


QUERIES |= {
    "knn_batch_l2": _batch("l2", "embedding", "vec_id % 20 = 0"),
    "knn_batch_ip": _batch("ip", "scaled", "vec_id % 20 = 0"),
    "knn_batch_filtered": _batch("l2", "scaled", "vec_id % 20 = 0", "label IN (1, 2, 3)"),
    "knn_batch_all": _batch("l2", "embedding", "true"),
}


@query
def ivf_knn_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall of the approximate search against the exact one, for the queries whose id is divisible by 20."""
    df = read(spark, sf_dir, "embeddings")
    index = build_ivf(df, "embedding", "vec_id", "l2", scratch(spark, "ivf"))
    queries = [list(r.embedding) for r in df.where("vec_id % 20 = 0").orderBy("vec_id").select("embedding").collect()]
    truth = exact_ids(spark, df, "embedding", "vec_id", queries, 10, "l2")
    got: list[set[int]] = [set() for _ in queries]
    for r in index.search(spark, np.array(queries), 10, max(1, len(index.centres) * 2 // 3)).collect():
        got[r.query_idx].add(r.vec_id)
    hits = sum(len(a & b) for a, b in zip(truth, got, strict=True))
    return spark.createDataFrame([(len(queries), hits / max(1, sum(map(len, truth))))], "queries int, recall double")


# Tables

VECTOR_SCHEMA = "vec_id int64 not null, label int32 not null, embedding fixed_size_list[64, float32]"


def vector_table(spark: SparkSession, sf_dir: str, **options: object) -> Engine:
    """An engine with a table `vectors`, in a segment a label."""
    engine = Engine(spark, scratch(spark, "engine"))
    segments = {"segment_type": "value", "segment_keys": ["label"], "segment_key_composition_type": "single"}
    index = [{"column_id": "2", "index_type": "Hnsw", "parameters": {"space": "L2Space", "M": "16", "ef_construction": "100"}}]
    engine.create(VECTOR_SCHEMA, "vectors", **({"segmentation_info": segments, "index_info": index, "active_set_size_limit": 20} | options))
    engine.insert("vectors", read(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding"))
    return engine


def _one(spark: SparkSession, **values: int) -> DataFrame:
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} long" for k in values))


@query
def scan_deleted_excluded(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = vector_table(spark, sf_dir)
    engine.delete("vectors", "label = 4 AND vec_id < 200")
    return engine.scan("vectors", "vec_id, label")


@query
def scan_internal_deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = vector_table(spark, sf_dir)
    engine.delete("vectors", "label IN (4, 5)")
    return engine.scan("vectors", f"{DELETED}, vec_id", f"{DELETED} = true", internal=True).withColumnRenamed(DELETED, "deleted")


@query
def knn_deleted_excluded(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = vector_table(spark, sf_dir)
    engine.delete("vectors", "vec_id < 100")
    found = engine.ann("vectors", "embedding", 10, vector(read(spark, sf_dir, "embeddings"), 0), projection="vec_id, label")
    return found


@query
def delete_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = vector_table(spark, sf_dir)
    n = engine.delete("vectors", "label < 3")
    return _one(spark, deleted=n, left=engine.count_records("vectors"))


@query
def delete_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = vector_table(spark, sf_dir)
    n = engine.delete("vectors")
    return _one(spark, deleted=n, left=engine.count_records("vectors"))


ORDER_SCHEMA = "o_orderkey int64 not null, o_custkey int64, o_orderstatus string, o_totalprice float64"


def order_table(spark: SparkSession, sf_dir: str, segmentation: dict | None = None) -> Engine:
    engine = Engine(spark, scratch(spark, "engine"))
    engine.create(ORDER_SCHEMA, "orders", **({"segmentation_info": segmentation} if segmentation else {}))
    engine.insert("orders", read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"))
    return engine


@query
def update_scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = order_table(spark, sf_dir)
    engine.update("orders", "o_orderstatus = 'X, Y', o_totalprice = 1.5", "o_totalprice > 300000")
    return engine.scan("orders")


@query
def update_vector_then_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = vector_table(spark, sf_dir)
    source = read(spark, sf_dir, "embeddings")
    q = vector(source, 0)
    engine.update("vectors", f"embedding = {json.dumps(q)}", "vec_id IN (7, 8)")
    return engine.ann("vectors", "embedding", 3, q, projection="vec_id")


@query
def update_moves_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = vector_table(spark, sf_dir)
    engine.update("vectors", "label = 42", "label = 1")
    return engine.scan("vectors", "vec_id, label")


@query
def insert_text_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of nation as text, parsed back."""
    from tessera.sources.rows import COLUMN_MARK, parse_rows

    nation = read(spark, sf_dir, "nation")
    text = nation.select(F.concat_ws(COLUMN_MARK, *[F.col(c).cast("string") for c in nation.columns]).alias("row"))
    return parse_rows(text, "row", T.StructType(nation.schema.fields))


@query
def insert_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of nation through an Arrow stream into a table and out again."""
    engine = Engine(spark, scratch(spark, "engine"))
    engine.create("n_nationkey int32 not null, n_name string, n_regionkey int32", "nation", segmentation_info={"segment_type": "value", "segment_keys": ["n_nationkey"], "segment_key_composition_type": "single"})
    engine.insert("nation", to_ipc(read(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")))
    return engine.scan("nation")


def _keyed(spark: SparkSession) -> Engine:
    engine = Engine(spark, scratch(spark, "engine"))
    schema = T.StructType([T.StructField("k", T.LongType(), False, {"primary_key": True}), T.StructField("name", T.StringType())])
    engine.create(schema, "keyed")
    return engine


@query
def insert_pk_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine, rows = _keyed(spark), read(spark, sf_dir, "customer").select("c_custkey", "c_name")
    first = engine.insert("keyed", rows)
    second = engine.insert("keyed", rows)
    return _one(spark, first=first, second=second, n=engine.count_records("keyed"))


@query
def insert_pk_partial_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine, rows = _keyed(spark), read(spark, sf_dir, "customer").select("c_custkey", "c_name")
    engine.insert("keyed", rows.where("c_custkey <= 900"))
    engine.insert("keyed", rows.where("c_custkey > 600").withColumn("c_name", F.lit("later")))
    return engine.scan("keyed")


# Segments

EVENT_SCHEMA = "event_id int64 not null, event_type string not null, user_id int64 not null, value float64"


def event_table(spark: SparkSession, sf_dir: str, segmentation: dict) -> Engine:
    engine = Engine(spark, scratch(spark, "engine"))
    engine.create(EVENT_SCHEMA, "events", segmentation_info=segmentation, active_set_size_limit=500)
    rows = read(spark, sf_dir, "events").select("event_id", "event_type", (F.col("user_id") % 3).alias("user_id"), "value")
    engine.insert("events", rows)
    return engine


VALUE = {"segment_type": "value", "segment_keys": ["event_type"], "segment_key_composition_type": "single"}
COMPOSITE = {"segment_type": "value", "segment_keys": ["event_type", "user_id"], "segment_key_composition_type": "composite"}
HASH = {"segment_type": "hash", "segment_keys": ["user_id"], "segment_key_composition_type": "single", "num_buckets": 4}


@query
def segment_value_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_table(spark, sf_dir, VALUE).scan("events", "event_id, value", "event_type = 'click' AND value > 5")


@query
def segment_composite_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_table(spark, sf_dir, COMPOSITE).scan("events", "event_id, user_id, event_type", "NOT event_type = 'click' AND user_id = 2")


@query
def segment_hash_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_table(spark, sf_dir, HASH).scan("events", "event_id, user_id", "user_id IN (0, 1)")


@query
def segment_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = event_table(spark, sf_dir, COMPOSITE)
    return engine.segment_statistics_frame("events").select("segment_id", "row_count")


@query
def segment_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = vector_table(spark, sf_dir)
    engine.delete("vectors", "vec_id < 50")
    return engine.segment_statistics_frame("vectors").withColumn("indexed", F.col("indexed_row_count.embedding")).drop("indexed_row_count")


# Counters, cursors, snapshots


@query
def count_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = vector_table(spark, sf_dir)
    engine.delete("vectors", "label = 9")
    return stats.count_records(engine.table("vectors"))


@query
def total_record_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = vector_table(spark, sf_dir)
    engine.create("n_nationkey int32, n_name string, n_regionkey int32", "nation")
    engine.insert("nation", read(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey"))
    engine.delete("vectors", "label = 9")
    total, deleted = engine.total_record_count()
    tables, unloaded = engine.total_table_count()
    return _one(spark, total=total, deleted=deleted, tables=tables, unloaded=unloaded)


@query
def count_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = vector_table(spark, sf_dir)
    n, by_column = engine.count_indexed_elements("vectors")
    return _one(spark, n=n, indexed=by_column["embedding"][1])


@query
def cursor_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sizes of the pages of a cursor."""
    cursors, sizes = CursorRegistry(), []
    page, more = cursors.open("u", scan(read(spark, sf_dir, "supplier"), "s_suppkey, s_name"), 30)
    sizes.append(page.num_rows)
    while more:
        page, more = cursors.fetch("u")
        sizes.append(page.num_rows)
    return spark.createDataFrame(list(enumerate(sizes)), "page long, n long")


@query
def cursor_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    cursors = CursorRegistry()
    page, more = cursors.open("u", scan(read(spark, sf_dir, "supplier"), "s_suppkey", "", 7), 30)
    return _one(spark, n=page.num_rows, more=int(more))


@query
def snapshot_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine, path = order_table(spark, sf_dir), scratch(spark, "snapshot")
    engine.delete("orders", "o_orderkey < 100")
    engine.unload("orders", path)
    engine.load("orders", path)
    return engine.scan("orders")


@query
def list_and_describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = vector_table(spark, sf_dir)
    rows = [(t, f.name, f.dataType.simpleString()) for t in engine.list_tables() for f in engine.describe(t, internal=True).fields]
    return spark.createDataFrame(rows, "table_name string, column_name string, type string")


@query
def arrow_stream_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_ipc(spark, to_ipc(scan(read(spark, sf_dir, "supplier"), "s_suppkey, s_name, s_acctbal")))


@query
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table filled twice from a stream of the same file: the primary key keeps each row once."""
    from tessera.streaming.ingest import ingest

    engine = _keyed(spark)
    schema = read(spark, sf_dir, "customer").schema
    for i in range(2):
        stream = spark.readStream.schema(schema).option("pathGlobFilter", "customer.parquet").parquet(sf_dir).select("c_custkey", "c_name")
        ingest(engine, "keyed", stream, scratch(spark, f"stream{i}")).awaitTermination()
    return engine.scan("keyed")



# Searches by record, in order, and after changes


@query
def knn_repeated_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that share the column that decides ties are found each for itself."""
    df = read(spark, sf_dir, "embeddings").withColumn("part", F.col("vec_id") % 5)
    return knn(df, "embedding", "part", vector(df, 0), 12, "l2", "vec_id, part, distance", DIGITS)


@query
def knn_string_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table without any integer column."""
    engine = Engine(spark, scratch(spark, "engine"))
    engine.create("name string not null, embedding fixed_size_list[64, float32]", "named", index_info=[{"column_id": "1", "index_type": "Hnsw", "parameters": {"space": "L2Space"}}])
    source = read(spark, sf_dir, "embeddings")
    engine.insert("named", source.select(F.concat(F.lit("v"), "vec_id").alias("name"), "embedding"))
    return engine.ann("named", "embedding", 10, vector(source, 0), projection="name")


@query
def batchann_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The streams of the batch command, in order although the distance isn't asked for."""
    import io

    import pyarrow as pa

    from tessera.plans.command import execute

    engine, source = vector_table(spark, sf_dir), read(spark, sf_dir, "embeddings")
    sink = io.BytesIO()
    asked = pa.table({"query": pa.array([vector(source, i) for i in (0, 20, 40)], pa.list_(pa.float32()))})
    with pa.ipc.new_stream(sink, asked.schema) as writer:
        writer.write_table(asked)
    streams = execute(engine, "TABLE", "BATCHANN", "vectors", "embedding", "6", sink.getvalue(), "10", "vec_id")
    found = [pa.ipc.open_stream(x).read_all()["vec_id"].to_pylist() for x in streams]
    return spark.createDataFrame([(20 * q, place, v) for q, ids in enumerate(found) for place, v in enumerate(ids)], "query long, place long, vec_id long")


@query
def ivf_all_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inverted file with all its cells, which is the exact search."""
    df = read(spark, sf_dir, "embeddings")
    index = build_ivf(df, "embedding", "vec_id", "l2", scratch(spark, "ivf"))
    asked = df.where("vec_id % 20 = 0").orderBy("vec_id").select("vec_id", "embedding").collect()
    found = index.search(spark, np.array([list(r.embedding) for r in asked]), 5, len(index.centres), DIGITS)
    return found.select((F.col("query_idx") * 20).alias("query_idx"), "vec_id", "distance")


@query
def ivf_after_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index finds neither deleted rows nor old values, and finds rows that came after it."""
    engine, source = vector_table(spark, sf_dir), read(spark, sf_dir, "embeddings")
    engine.delete("vectors", "vec_id < 40")
    engine.build_index("vectors", "embedding", scratch(spark, "ivf"))
    engine.delete("vectors", "vec_id >= 100 AND vec_id < 150")
    engine.update("vectors", f"embedding = {json.dumps(vector(source, 300))}", "vec_id = 200")
    engine.insert("vectors", source.where("vec_id < 20").select("vec_id", "label", "embedding"))
    return engine.approximate_ann("vectors", "embedding", 8, [vector(source, 120), vector(source, 300)], ef=1000).select("query_idx", "vec_id")


@query
def ann_ef(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows whatever ef is."""
    engine, q = vector_table(spark, sf_dir), vector(read(spark, sf_dir, "embeddings"), 0)
    found = [engine.ann("vectors", "embedding", 4, q, ef=ef, projection="vec_id").withColumn("ef", F.lit(ef)) for ef in (1, 500)]
    return found[0].unionByName(found[1])


@query
def several_vector_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table with two indexed columns of different metrics."""
    engine, source = Engine(spark, scratch(spark, "engine")), read(spark, sf_dir, "embeddings")
    spaces = [{"column_id": str(i), "index_type": "Hnsw", "parameters": {"space": space}} for i, space in ((1, "L2Space"), (2, "IPSpace"))]
    engine.create("vec_id int64 not null, a fixed_size_list[64, float32], b fixed_size_list[64, float32]", "two", index_info=spaces)
    engine.insert("two", source.select("vec_id", "embedding", F.transform("embedding", lambda x: (x * (1 + F.col("vec_id") % 7)).cast("float"))))
    q = vector(source, 0)
    found = [engine.ann("two", c, 5, q, projection="vec_id").withColumn("by", F.lit(c)) for c in ("a", "b")]
    return found[0].unionByName(found[1])


# Statements, errors and administration


@query
def insert_arrow_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches that are in memory already."""
    engine = Engine(spark, scratch(spark, "engine"))
    engine.create("r_regionkey int32, r_name string", "region")
    engine.insert("region", read(spark, sf_dir, "region").select(F.col("r_regionkey").cast("int"), "r_name").toArrow())
    return engine.scan("region")


@query
def cursor_internal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of an internal scan: deleted rows and their flag come too."""
    engine = vector_table(spark, sf_dir)
    engine.delete("vectors", "label = 2")
    page, more = engine.scan_open("u", "vectors", f"vec_id, {DELETED}", "", 0, True, 100)
    rows = page.to_pylist()
    while more:
        page, more = engine.fetch_next("u")
        rows += page.to_pylist()
    return spark.createDataFrame([(r["vec_id"], r[DELETED]) for r in rows], "vec_id long, deleted boolean")


@query
def debug_scan_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A debug scan prints every row."""
    engine = vector_table(spark, sf_dir)
    printed = [line.strip("|") for line in engine.debug_scan("vectors", "vec_id", "label < 8").splitlines() if line.startswith("|")]
    return spark.createDataFrame([(int(x),) for x in printed[1:]], "vec_id long")


@query
def save_load_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole database saved and loaded by another engine."""
    engine, path = order_table(spark, sf_dir), scratch(spark, "database")
    engine.create("n_nationkey int32, n_name string", "nation")
    engine.insert("nation", read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int"), "n_name"))
    engine.delete("orders", "o_orderkey < 50")
    engine.save_all(path)
    other = Engine(spark, scratch(spark, "engine"))
    other.load_all(path)
    counts = [other.scan(t).agg(F.count("*").alias("n")).withColumn("table_name", F.lit(t)) for t in other.list_tables()]
    return counts[0].unionByName(counts[1])


@query
def reopen_after_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Another engine over the same folder sees every finished statement; old files can go."""
    root = scratch(spark, "engine")
    engine = Engine(spark, root)
    engine.create(ORDER_SCHEMA, "orders")
    rows = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    for part in range(3):
        engine.insert("orders", rows.where(F.col("o_orderkey") % 3 == part))
    engine.delete("orders", "o_orderstatus = 'F'")
    engine.compact("orders")
    engine.vacuum("orders")
    return Engine(spark, root).scan("orders")


@query
def insert_rollback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch with a row that the schema forbids adds nothing."""
    engine = vector_table(spark, sf_dir)
    bad = read(spark, sf_dir, "embeddings").select("vec_id", "label", F.when(F.col("vec_id") == 17, F.slice("embedding", 1, 3)).otherwise(F.col("embedding")))
    try:
        engine.insert("vectors", bad)
        failed = 0
    except Exception:  # Spark's own error classes differ between its versions
        failed = 1
    return _one(spark, failed=failed, n=engine.count_records("vectors"))


@query
def errors_by_statement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The error that each wrong statement raises, by the name of its class."""
    engine = vector_table(spark, sf_dir)
    engine.create("a int32, v fixed_size_list[2, float32]", "plain")
    wrong = {
        "unknown column": lambda: engine.scan("vectors", "nope"),
        "empty projection": lambda: engine.scan("vectors", " , "),
        "unfinished filter": lambda: engine.scan("vectors", "*", "label = 1 OR"),
        "reserved column": lambda: engine.scan("vectors", "*", f"{DELETED} = true"),
        "query of another size": lambda: engine.ann("vectors", "embedding", 1, [1.0]),
        "column without index": lambda: engine.ann("plain", "v", 1, [1.0, 2.0]),
        "k of 0": lambda: engine.ann("vectors", "embedding", 0, [0.0] * 64),
        "unknown metric": lambda: engine.create("a int32, v fixed_size_list[2, float32]", "x", index_info=[{"column_id": "1", "index_type": "Hnsw", "parameters": {"space": "Manhattan"}}]),
        "open quote": lambda: engine.update("vectors", "label = 5'"),
        "unknown table": lambda: engine.scan("nope"),
    }
    rows = []
    for name, run in wrong.items():
        try:
            run()
            rows.append((name, "none"))
        except EngineError as e:
            rows.append((name, type(e).__name__))
    return spark.createDataFrame(rows, "statement string, error string")


@query
def check_indexing(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = vector_table(spark, sf_dir)
    return _one(spark, waiting=int(engine.check_indexing("vectors")))


@query
def metrics_and_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often statements ran, and the topics that are logged."""
    engine = order_table(spark, sf_dir)
    for _ in range(3):
        engine.scan("orders")
    engine.delete("orders", "o_orderkey = 1")
    topics = engine.system_log("set", "scan") + engine.system_log("set", "delete")
    rows = [(name, int(n)) for name, (n, _) in engine.metrics.items()] + [(f"log {t}", 1) for t in set(topics)]
    return spark.createDataFrame(rows, "name string, n long")


@query
def settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A changed setting holds for tables to come."""
    engine = Engine(spark, scratch(spark, "engine"))
    engine.config("set", "active-set-size-limit", "7")
    engine.create("r_regionkey int32, r_name string", "region")
    engine.insert("region", read(spark, sf_dir, "region").select(F.col("r_regionkey").cast("int"), "r_name"))
    return engine.segment_statistics_frame("region").select("active_set_size_limit", "row_count")
