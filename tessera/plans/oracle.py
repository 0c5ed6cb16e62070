"""DuckDB SQL for the registered queries."""

from __future__ import annotations

#: The grade is made in labels, so it is null where there is no label.
LABELLED = "(SELECT d.doc_id, lang, source, n_chars, quality, toxic, grade FROM documents d LEFT JOIN (SELECT *, CASE WHEN quality = 1 THEN 'good' ELSE 'bad' END grade FROM labels) l USING (doc_id))"

SCALED = "(SELECT *, list_transform(embedding, lambda x: x::DOUBLE * (1 + vec_id % 7)) scaled FROM embeddings)"


def _distance(metric: str, column: str) -> str:
    pairs = f"list_zip(v.{column}::DOUBLE[], q.embedding::DOUBLE[])"
    if metric == "l2":
        raw = f"list_sum(list_transform({pairs}, lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    else:
        raw = f"1 - list_inner_product(v.{column}::DOUBLE[], q.{column if metric == 'scaled_ip' else 'embedding'}::DOUBLE[])"
    if metric == "cosine":
        norm = lambda x: f"sqrt(list_inner_product({x}::DOUBLE[], {x}::DOUBLE[]))"
        raw = f"1 - list_inner_product(v.{column}::DOUBLE[], q.{column}::DOUBLE[]) / ({norm(f'v.{column}')} * {norm(f'q.{column}')})"
    return f"round({raw}, 5) + 0.0"


def _single(metric: str, column: str, k: int, q: int = 0, columns: str = "vec_id, label, distance", condition: str = "true") -> str:
    if metric == "l2":
        distance = f"round(list_sum(list_transform(list_zip(v.{column}::DOUBLE[], q.{column}::DOUBLE[]), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 5) + 0.0"
    elif metric == "ip":
        distance = f"round(1 - list_inner_product(v.{column}::DOUBLE[], q.{column}::DOUBLE[]), 5) + 0.0"
    else:
        distance = _distance(metric, column)
    return f"SELECT {columns} FROM (SELECT v.vec_id, v.label, {distance} AS distance FROM {SCALED} v, (SELECT * FROM {SCALED} WHERE vec_id = {q}) q WHERE {condition} ORDER BY distance, v.vec_id LIMIT {k})"


def _batch(metric: str, column: str, which: str, condition: str = "true") -> str:
    return f"""SELECT query_idx, vec_id, distance FROM (
        SELECT q.vec_id AS query_idx, v.vec_id, {_distance(metric, column)} AS distance FROM {SCALED} v, (SELECT * FROM embeddings WHERE {which}) q WHERE {condition})
        QUALIFY row_number() OVER (PARTITION BY query_idx ORDER BY distance, vec_id) <= 5"""


STATISTICS = """SELECT 'vectors' AS table_name, 'v1::value::single::label::["' || label || '"]::::' AS segment_id, count(*) AS row_count, count(*) FILTER (vec_id >= 50) AS indexed,
    count(*) FILTER (vec_id < 50) AS deleted_row_count, count(*) - ((count(*) - 1) // 20) * 20 AS active_set_row_count, 20::BIGINT AS active_set_size_limit, (count(*) - 1) // 20 AS inactive_set_count FROM embeddings GROUP BY label"""

ORACLE: dict[str, str] = {
    "scan_star": "SELECT * FROM nation",
    "scan_projection": "SELECT c_custkey, c_name FROM customer",
    "scan_projection_reordered": "SELECT c_name, c_acctbal, c_custkey FROM customer WHERE c_custkey > 10",
    "scan_empty_filter": "SELECT r_name FROM region",
    "scan_limit_count": "SELECT count(*) AS n FROM (SELECT 1 FROM orders WHERE o_totalprice > 1000 LIMIT 250)",
    "scan_limit_zero": "SELECT count(*) AS n FROM orders",
    "filter_eq": "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber = 3",
    "filter_ne": "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber <> 3",
    "filter_ne_alt": "SELECT p_partkey, p_size FROM part WHERE p_size <> 7",
    "filter_lt": "SELECT p_partkey, p_retailprice FROM part WHERE p_retailprice < 950.5",
    "filter_le": "SELECT p_partkey, p_size FROM part WHERE p_size <= 10",
    "filter_gt": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 200000",
    "filter_ge": "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity >= 49",
    "filter_eq_string": "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment = 'BUILDING'",
    "filter_cmp_string": "SELECT c_custkey, c_name FROM customer WHERE c_name >= 'Customer#000000100' AND c_name < 'Customer#000000900'",
    "filter_is_null": f"SELECT doc_id FROM {LABELLED} WHERE quality IS NULL",
    "filter_is_not_null": f"SELECT doc_id, quality FROM {LABELLED} WHERE quality IS NOT NULL",
    "filter_in_int": f"SELECT doc_id, quality FROM {LABELLED} WHERE coalesce(quality IN (0, 5), false)",
    "filter_in_string": f"SELECT doc_id, grade FROM {LABELLED} WHERE coalesce(grade IN ('bad', 'null'), false)",
    "filter_not_in_keeps_null": f"SELECT doc_id, quality FROM {LABELLED} WHERE NOT coalesce(quality IN (1), false)",
    "filter_in_null": f"SELECT doc_id, quality FROM {LABELLED} WHERE coalesce(quality IN (0), false) OR quality IS NULL",
    "filter_not_in_null": f"SELECT doc_id, quality FROM {LABELLED} WHERE NOT (coalesce(quality IN (0), false) OR quality IS NULL)",
    "filter_like_prefix": "SELECT p_partkey, p_type FROM part WHERE p_type LIKE 'S%'",
    "filter_like_suffix": "SELECT p_partkey, p_brand FROM part WHERE p_brand LIKE '%3'",
    "filter_like_contains": "SELECT page_id FROM pages WHERE url LIKE '%example.com%'",
    "filter_like_underscore": "SELECT p_partkey, p_brand FROM part WHERE p_brand LIKE 'Brand#_2'",
    "filter_not_like": "SELECT page_id FROM pages WHERE url NOT LIKE 'https%'",
    "filter_not_like_null": f"SELECT doc_id, grade FROM {LABELLED} WHERE grade NOT LIKE 'b%'",
    "filter_and": "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity < 10 AND l_discount > 0.05::DOUBLE AND l_returnflag = 'R'",
    "filter_or": "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity < 2 OR l_quantity > 49",
    "filter_not": "SELECT l_orderkey, l_linenumber FROM lineitem WHERE NOT l_returnflag = 'N'",
    "filter_precedence": "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber = 1 OR (l_linenumber = 2 AND l_returnflag <> 'N')",
    "filter_nested": "SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_linenumber = 1 OR (l_quantity > 40 AND NOT (l_discount < 0.02::DOUBLE OR l_tax >= 0.07::DOUBLE))) AND l_linestatus <> 'O'",
    "filter_kleene_or_null": f"SELECT doc_id FROM {LABELLED} WHERE quality = 1 OR lang = 'en'",
    "filter_kleene_not_null": f"SELECT doc_id FROM {LABELLED} WHERE NOT (quality = 1 AND lang = 'en')",
    "filter_canonical": """SELECT * FROM (VALUES
        (0, '(l_suppkey < 40 OR (NOT l_linestatus LIKE ''_O%'' AND l_orderkey IN [7, 8, 9]))', 'l_linestatus,l_orderkey,l_suppkey'),
        (1, 'l_linestatus IS NOT NULL', 'l_linestatus'),
        (2, '(NOT (l_partkey >= 12 OR l_partkey NOT IN [3]) AND (l_returnflag IS NULL OR l_extendedprice <= 100.5))', 'l_extendedprice,l_partkey,l_returnflag')) t(i, canonical, columns)""",
    "knn_filtered": _single("l2", "embedding", 10, condition="v.label <> 3"),
    "knn_l2_single": _single("l2", "embedding", 10),
    "knn_ip_single": _single("ip", "embedding", 10),
    "knn_l2_scaled": _single("l2", "scaled", 10),
    "knn_ip_scaled": _single("ip", "scaled", 10),
    "knn_cosine": _single("cosine", "scaled", 10),
    "knn_projection_distance_first": _single("l2", "embedding", 5, 5, "distance, vec_id"),
    "knn_without_distance": _single("ip", "embedding", 5, 5, "label, vec_id"),
    "knn_filtered_none": _single("l2", "embedding", 10, condition="v.label = 77"),
    "knn_k_exceeds_rows": _single("l2", "embedding", 100, condition="v.vec_id < 20"),
    "knn_range": f"SELECT * FROM ({_single('l2', 'embedding', 1_000_000, columns='vec_id, distance')}) WHERE distance <= 1.7",
    "knn_all_distances": _single("ip", "scaled", 1_000_000, 3, "vec_id, distance"),
    "knn_batch_l2": _batch("l2", "embedding", "vec_id % 20 = 0"),
    "knn_batch_ip": _batch("ip", "scaled", "vec_id % 20 = 0"),
    "knn_batch_filtered": _batch("l2", "scaled", "vec_id % 20 = 0", "v.label IN (1, 2, 3)"),
    "knn_batch_all": _batch("l2", "embedding", "true"),
    "scan_deleted_excluded": "SELECT vec_id, label FROM embeddings WHERE NOT (label = 4 AND vec_id < 200)",
    "scan_internal_deleted": "SELECT true AS deleted, vec_id FROM embeddings WHERE label IN (4, 5)",
    "knn_deleted_excluded": _single("l2", "embedding", 10, columns="vec_id, label", condition="v.vec_id >= 100"),
    "delete_count": "SELECT count(*) FILTER (label < 3) AS deleted, count(*) FILTER (label >= 3) AS left FROM embeddings",
    "delete_all": "SELECT count(*) AS deleted, 0::BIGINT AS left FROM embeddings",
    "update_scalar": "SELECT o_orderkey, o_custkey, CASE WHEN o_totalprice > 300000 THEN 'X, Y' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_totalprice > 300000 THEN 1.5::DOUBLE ELSE o_totalprice END AS o_totalprice FROM orders",
    "update_vector_then_knn": "SELECT unnest([0, 7, 8])::BIGINT AS vec_id",
    "update_moves_segment": "SELECT vec_id, CASE WHEN label = 1 THEN 42 ELSE label END AS label FROM embeddings",
    "insert_text_rows": "SELECT * FROM nation",
    "insert_batch": "SELECT n_nationkey, n_name, n_regionkey FROM nation",
    "insert_pk_skip": "SELECT count(*) AS first, 0::BIGINT AS second, count(*) AS n FROM customer",
    "insert_pk_partial_overlap": "SELECT c_custkey AS k, CASE WHEN c_custkey <= 900 THEN c_name ELSE 'later' END AS name FROM customer",
    "segment_value_prune": "SELECT event_id, value FROM events WHERE event_type = 'click' AND value > 5",
    "segment_composite_prune": "SELECT event_id, user_id % 3 AS user_id, event_type FROM events WHERE event_type <> 'click' AND user_id % 3 = 2",
    "segment_hash_rows": "SELECT event_id, user_id % 3 AS user_id FROM events WHERE user_id % 3 IN (0, 1)",
    "segment_ids": """SELECT 'v1::value::comp::event_type+user_id::["' || event_type || '","' || (user_id % 3) || '"]::::' AS segment_id, count(*) AS row_count FROM events GROUP BY 1""",
    "segment_statistics": STATISTICS,
    "count_records": "SELECT count(*) AS n FROM embeddings WHERE label <> 9",
    "total_record_count": "SELECT (SELECT count(*) FROM embeddings) + (SELECT count(*) FROM nation) AS total, (SELECT count(*) FROM embeddings WHERE label = 9) AS deleted, 2::BIGINT AS tables, 0::BIGINT AS unloaded",
    "count_indexed": "SELECT count(*) AS n, count(embedding) AS indexed FROM embeddings",
    "cursor_pages": "SELECT i AS page, least(30, n - 30 * i) AS n FROM (SELECT count(*) n FROM supplier), range(0, 100000) t(i) WHERE 30 * i < n",
    "cursor_limit": "SELECT least(7, count(*)) AS n, 0::BIGINT AS more FROM supplier",
    "snapshot_roundtrip": "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey >= 100",
    "list_and_describe": """SELECT 'vectors' AS table_name, * FROM (VALUES ('vec_id', 'bigint'), ('label', 'int'), ('embedding', 'array<float>'), ('__deleted_flag', 'boolean')) t(column_name, type)""",
    "arrow_stream_roundtrip": "SELECT s_suppkey, s_name, s_acctbal FROM supplier",
    "stream_ingest": "SELECT c_custkey AS k, c_name AS name FROM customer",
    "knn_repeated_key": f"SELECT vec_id, vec_id % 5 AS part, distance FROM ({_single('l2', 'embedding', 12)})",
    "knn_string_key": f"SELECT 'v' || vec_id AS name FROM ({_single('l2', 'embedding', 10)})",
    "batchann_order": f"""SELECT query, row_number() OVER (PARTITION BY query ORDER BY distance, vec_id) - 1 AS place, vec_id FROM (
        {" UNION ALL ".join(f"SELECT {q}::BIGINT AS query, vec_id, distance FROM ({_single('l2', 'embedding', 6, q)})" for q in (0, 20, 40))})""",
    "ivf_all_cells": _batch("l2", "embedding", "vec_id % 20 = 0"),
    "ivf_after_delete": f"""WITH now AS (SELECT vec_id, CASE WHEN vec_id = 200 THEN (SELECT embedding FROM embeddings WHERE vec_id = 300) ELSE embedding END AS embedding
            FROM embeddings WHERE vec_id < 20 OR (vec_id >= 40 AND NOT vec_id BETWEEN 100 AND 149)),
        asked AS (SELECT i AS query_idx, embedding AS q FROM embeddings JOIN (VALUES (0::BIGINT, 120), (1, 300)) t(i, id) ON vec_id = id)
        SELECT query_idx, vec_id FROM (SELECT query_idx, vec_id, list_sum(list_transform(list_zip(embedding::DOUBLE[], q::DOUBLE[]), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM now, asked)
        QUALIFY row_number() OVER (PARTITION BY query_idx ORDER BY round(d, 9), vec_id) <= 8""",
    "ann_ef": f"SELECT vec_id, ef FROM ({_single('l2', 'embedding', 4)}), (VALUES (1), (500)) t(ef)",
    "several_vector_columns": f"SELECT vec_id, 'a' AS by FROM ({_single('l2', 'embedding', 5)}) UNION ALL SELECT vec_id, 'b' FROM (SELECT v.vec_id FROM {SCALED} v, (SELECT embedding AS q FROM embeddings WHERE vec_id = 0) ORDER BY 1 - list_inner_product(v.scaled::DOUBLE[], q::DOUBLE[]), v.vec_id LIMIT 5)",
    "insert_arrow_table": "SELECT r_regionkey::INT AS r_regionkey, r_name FROM region",
    "cursor_internal": "SELECT vec_id, label = 2 AS deleted FROM embeddings",
    "debug_scan_full": "SELECT vec_id FROM embeddings WHERE label < 8",
    "save_load_all": "SELECT 'nation' AS table_name, count(*) AS n FROM nation UNION ALL SELECT 'orders', count(*) FROM orders WHERE o_orderkey >= 50",
    "reopen_after_statements": "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus <> 'F'",
    "insert_rollback": "SELECT 1::BIGINT AS failed, count(*) AS n FROM embeddings",
    "errors_by_statement": """SELECT * FROM (VALUES ('unknown column', 'ColumnNotFound'), ('empty projection', 'EngineError'), ('unfinished filter', 'FilterSyntaxError'), ('reserved column', 'ColumnNotFound'), ('query of another size', 'EngineError'),
        ('column without index', 'EngineError'), ('k of 0', 'EngineError'), ('unknown metric', 'EngineError'), ('open quote', 'EngineError'), ('unknown table', 'EngineError')) t(statement, error)""",
    "check_indexing": "SELECT 0::BIGINT AS waiting",
    "metrics_and_logs": "SELECT * FROM (VALUES ('BatchInsertCommand', 1::BIGINT), ('Scan', 3), ('DeleteCommand', 1), ('log scan', 1), ('log delete', 1)) t(name, n)",
    "settings": "SELECT 7::BIGINT AS active_set_size_limit, count(*) AS row_count FROM region",
}
