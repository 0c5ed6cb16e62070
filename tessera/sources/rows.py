"""Rows from text and from Arrow streams, and results as Arrow streams."""

from __future__ import annotations

import io

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.errors import EngineError

COLUMN_MARK, ITEM_MARK = "\u001e", "\u001d"


def _cast(text: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.BooleanType):
        low = F.lower(text)
        return F.when(low.isin("true", "1"), F.lit(True)).when(low.isin("false", "0"), F.lit(False)).otherwise(F.raise_error(F.concat(F.lit("not a boolean: "), text)).cast("boolean"))
    return text.cast(kind)


def parse_rows(df: DataFrame, column: str, schema: T.StructType) -> DataFrame:
    """Rows of a schema from text: columns between U+001E, list items between U+001D.

    Too few or too many columns, and text that isn't of a column's type, fail the query. An empty list is empty text; there
    is no text for null.
    """
    n = len(schema.fields)
    parts = F.split(F.col(column), COLUMN_MARK, -1)
    parts = F.when(F.size(parts) == n, parts).when(F.size(parts) < n, F.raise_error(F.lit("Not enough column is provided.")).cast("array<string>")).otherwise(F.raise_error(F.lit("Too many columns are provided.")).cast("array<string>"))
    rows = df.select(parts.alias("__p"))
    out = []
    for i, f in enumerate(schema.fields):
        text = F.col("__p")[i]
        if isinstance(f.dataType, T.ArrayType):
            items = F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, ITEM_MARK, -1))
            value = F.transform(items, _caster(f.dataType.elementType))
        else:
            value = _cast(text, f.dataType)
        out.append(value.alias(f.name))
    return rows.select(*out)


def _caster(kind: T.DataType):
    return lambda x: _cast(x, kind)


def text_row(spark: SparkSession, row: str, schema: T.StructType) -> DataFrame:
    return parse_rows(spark.createDataFrame([(row,)], "r string"), "r", schema)


def from_ipc(spark: SparkSession, data: bytes) -> DataFrame:
    """The rows of an Arrow IPC stream."""
    try:
        got = pa.ipc.open_stream(io.BytesIO(data)).read_all()
    except pa.ArrowInvalid as e:
        raise EngineError(f"Not an Arrow stream: {e}") from None
    return spark.createDataFrame(_spark_types(got))


def _spark_types(got: pa.Table) -> pa.Table:
    """Unsigned numbers as wider signed ones, fixed-size lists as lists."""
    def kind(t: pa.DataType) -> pa.DataType:
        if pa.types.is_fixed_size_list(t) or pa.types.is_list(t) or pa.types.is_large_list(t):
            return pa.list_(kind(t.value_type))
        wider = {pa.uint8(): pa.int16(), pa.uint16(): pa.int32(), pa.uint32(): pa.int64(), pa.uint64(): pa.decimal128(20, 0), pa.large_string(): pa.string()}
        return wider.get(t, t)

    return pa.table({f.name: got[f.name].cast(kind(f.type)) for f in got.schema}) if got.num_columns else got


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """df's columns, by place, under the schema's names; their types must be the schema's, names don't matter."""
    if len(df.columns) != len(schema.fields):
        raise EngineError(f"The table has {len(schema.fields)} columns, the rows {len(df.columns)}.")
    same = lambda a, b: (isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType) and a.elementType == b.elementType) or a == b
    for have, want in zip(df.schema.fields, schema.fields, strict=True):
        if not same(have.dataType, want.dataType):
            raise EngineError(f"Column '{want.name}' is {want.dataType.simpleString()}, not {have.dataType.simpleString()}.")
    return df.toDF(*schema.names)


def to_ipc(df: DataFrame) -> bytes:
    """A result, which the caller has bounded by a limit or a k, as an Arrow IPC stream."""
    got = df.toArrow()
    out = io.BytesIO()
    with pa.ipc.new_stream(out, got.schema) as writer:
        writer.write_table(got)
    return out.getvalue()
