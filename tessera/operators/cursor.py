"""Cursors: results read page by page."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema

from tessera.errors import EngineError


@dataclass
class Cursor:
    rows: Iterator
    schema: pa.Schema
    page: int
    ahead: list = field(default_factory=list)
    used: float = 0.0

    def next_page(self) -> tuple[pa.Table, bool]:
        """(page, whether there is more): one row is read ahead to know."""
        take = self.ahead
        for row in self.rows:
            take.append(row)
            if len(take) > self.page:
                break
        now, self.ahead = take[: self.page], take[self.page :]
        return pa.Table.from_pylist([r.asDict(recursive=True) for r in now], schema=self.schema), bool(self.ahead)


class CursorRegistry:
    """Open cursors by uuid. Rows come to the driver a partition at a time; idle cursors expire."""

    def __init__(self, ttl: float = 600.0, clock: Callable[[], float] = time.monotonic) -> None:
        self.open_cursors: dict[str, Cursor] = {}
        self.ttl, self.clock = ttl, clock

    def sweep(self) -> int:
        """Drop expired cursors; how many."""
        old = [u for u, c in self.open_cursors.items() if self.clock() - c.used > self.ttl]
        for u in old:
            del self.open_cursors[u]
        return len(old)

    def open(self, uuid: str, df: DataFrame, page: int = 10_000) -> tuple[pa.Table, bool]:
        self.sweep()
        if uuid in self.open_cursors:
            raise EngineError(f"Cursor '{uuid}' is already open.")
        if page < 1:
            raise EngineError("A page has at least one row.")
        self.open_cursors[uuid] = Cursor(df.toLocalIterator(prefetchPartitions=True), to_arrow_schema(df.schema), page, used=self.clock())
        return self.fetch(uuid)

    def fetch(self, uuid: str) -> tuple[pa.Table, bool]:
        """The next page; the last one closes the cursor."""
        self.sweep()
        if uuid not in self.open_cursors:
            raise EngineError(f"Cursor '{uuid}' is not open.")
        cursor = self.open_cursors[uuid]
        cursor.used = self.clock()
        got, more = cursor.next_page()
        if not more:
            del self.open_cursors[uuid]
        return got, more

    def close(self, uuid: str) -> None:
        self.open_cursors.pop(uuid, None)
