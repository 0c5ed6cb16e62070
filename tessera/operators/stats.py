"""Counters of tables and segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.types import DELETED


def count_records(df: DataFrame) -> DataFrame:
    """n: the live rows."""
    return df.where(~F.col(DELETED)).agg(F.count("*").alias("n"))


def total_counts(tables: list[DataFrame]) -> DataFrame:
    """(total, deleted) over all tables; each table is counted by itself, and the counts are added."""
    each = [t.agg(F.count("*").alias("total"), F.count_if(DELETED).alias("deleted")) for t in tables]
    out = each[0]
    for e in each[1:]:
        out = out.unionByName(e)
    return out.agg(F.sum("total").alias("total"), F.sum("deleted").alias("deleted"))


def count_indexed(df: DataFrame, columns: list[str]) -> DataFrame:
    """(n, a column for each indexed one): live rows, and those with a vector."""
    return df.where(~F.col(DELETED)).agg(F.count("*").alias("n"), *[F.count(f"`{c}`").alias(c) for c in columns])


def segment_statistics(df: DataFrame, segment: Column, table: str, limit: int, indexed: list[str]) -> DataFrame:
    """A row a segment. Sets fill up to `limit` rows: all but the last are inactive, and a full last one is still active."""
    grouped = df.withColumn("segment_id", segment).groupBy("segment_id").agg(
        F.count("*").alias("row_count"), F.count_if(DELETED).alias("deleted_row_count"), *[F.count(F.when(~F.col(DELETED), F.col(f"`{c}`"))).alias(f"__{c}") for c in indexed]
    )
    inactive = F.floor((F.col("row_count") - 1) / limit).cast("long")
    counts = F.struct(*[F.col(f"`__{c}`").alias(c) for c in indexed]) if indexed else F.create_map().cast("map<string,long>")
    return grouped.select(F.lit(table).alias("table_name"), "segment_id", "row_count", counts.alias("indexed_row_count"), "deleted_row_count", (F.col("row_count") - inactive * limit).alias("active_set_row_count"), F.lit(limit).cast("long").alias("active_set_size_limit"), inactive.alias("inactive_set_count"))
