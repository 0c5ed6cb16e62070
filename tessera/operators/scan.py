"""Scans: projection, filter and limit."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.errors import ColumnNotFound, EngineError
from tessera.functions.filters import guard_reserved, parse_filter
from tessera.types import DELETED


def project(projection: str, columns: Sequence[str], hidden: Sequence[str] = (DELETED,)) -> list[str]:
    """The names of a projection: '*' for all that aren't hidden, or a list in its own order; empty parts are dropped."""
    if projection.strip() == "*":
        return [c for c in columns if c not in hidden]
    names = [p.strip() for p in projection.split(",") if p.strip()]
    if not names:
        raise EngineError("The projection is empty.")
    for n in names:
        if n not in columns or n in hidden:
            raise ColumnNotFound(n)
    return names


def where(df: DataFrame, filter_text: str, internal: bool = False) -> DataFrame:
    """The rows a filter holds for. Unless internal, deleted rows are hidden and reserved columns unknown."""
    tree = parse_filter(filter_text, df.schema)
    if not internal:
        guard_reserved(tree)
        if DELETED in df.columns:
            df = df.where(~F.col(DELETED))
    return df.where(tree.column()) if tree else df


def scan(df: DataFrame, projection: str = "*", filter_text: str = "", limit: int = 0, internal: bool = False) -> DataFrame:
    """SELECT projection WHERE filter LIMIT limit, without a limit for 0; internal: with deleted rows and the deletion flag."""
    if limit < 0:
        raise EngineError("The limit must not be negative.")
    if not projection.strip():
        raise EngineError("The projection is empty.")
    names = project(projection, df.columns, () if internal else (DELETED,))
    out = where(df, filter_text, internal).select(*[F.col(f"`{n}`") for n in names])
    return out.limit(limit) if limit else out


def debug_scan(df: DataFrame, projection: str = "*", filter_text: str = "", rows: int = 2_000_000_000) -> str:
    """The whole result of a scan as a text table, for small tables."""
    return scan(df, projection, filter_text)._jdf.showString(rows, 0, False)
