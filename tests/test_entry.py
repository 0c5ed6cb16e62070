import __spark_entry__ as entry
import pytest


def test_every_query_is_callable_and_sql_belongs_to_one():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert all(map(callable, queries.values())) and set(sql) <= set(queries)


@pytest.mark.parametrize("name", ["scan_star", "filter_nested", "knn_filtered", "knn_batch_ip", "segment_ids", "update_moves_segment"])
def test_against_duckdb(spark, name):
    import duckdb

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("nation", "lineitem", "embeddings", "events", "documents", "labels"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    got = entry.queries()[name](spark, sf).toArrow()
    want = con.sql(entry.oracle_sql()[name]).to_arrow_table()
    key = lambda t: sorted(tuple(round(r[c], 5) if isinstance(r[c], float) else r[c] for c in sorted(t.column_names)) for r in t.to_pylist())
    assert sorted(got.column_names) == sorted(want.column_names) and key(got) == key(want)


def test_flagship(spark):
    assert entry.entry(spark).columns == ["vec_id", "label", "distance"]


def test_stream(spark):
    assert entry.queries()["stream_ingest"](spark, "/root/testdata/sf0.001").count() == spark.read.parquet("/root/testdata/sf0.001/customer.parquet").count()
