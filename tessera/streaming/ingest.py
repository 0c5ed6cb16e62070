"""Continuous ingest: a stream into a table, and windowed counts of a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.engine import Engine
from tessera.sources.rows import conform


def ingest(engine: Engine, name: str, stream: DataFrame, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append each micro-batch of a stream to a table.

    The table's manifest has the number of the last batch of each checkpoint, so a batch that runs again after a failure
    brings no row twice.
    """
    table = engine.catalog.get(name)

    def append(batch: DataFrame, number: int) -> None:
        rows = conform(batch, table.schema)
        engine.insert(name, rows.dropDuplicates([table.primary_key]) if table.primary_key else rows, stream=(checkpoint, number))

    writer = stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def windowed_counts(stream: DataFrame, time: str, width: str, late: str, *keys: str) -> DataFrame:
    """Rows in each window of `width` by keys, for rows at most `late` behind."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), *keys).agg(F.count("*").alias("n"))
