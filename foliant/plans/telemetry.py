"""A log of a collection's queries and writes: what was asked, its plan and how long it took."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from foliant.plans.collection import Collection, Cursor

SCHEMA = "collection string, event string, selector string, options string, plan_hash int, seconds double, calls long"


class Telemetry:
    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.rows = spark, {}

    def watch(self, collection: Collection) -> None:
        for event in ("find", "findOne", "updateOne", "updateMany", "replaceOne", "removeOne", "removeMany", "added"):
            collection.on(event, lambda *args, e=event: self.note(collection.name, e, args[0] if args else None, args[1:]))

    def note(self, name: str, event: str, selector: Any, options: Any = (), plan: int | None = None, seconds: float | None = None) -> None:
        """Equal calls are one row with their number."""
        key = (name, event, repr(selector), repr(options))
        old = self.rows.get(key, (None, 0.0, 0))
        self.rows[key] = (plan if plan is not None else old[0], old[1] + (seconds or 0.0), old[2] + 1)

    @contextmanager
    def timed(self, name: str, cursor: Cursor) -> Iterator[Cursor]:
        self.spark.sparkContext.setJobDescription(f"{name}: {cursor.selector!r}")
        began = time.monotonic()
        try:
            yield cursor
        finally:
            self.spark.sparkContext.setJobDescription(None)
            self.note(name, "timed", cursor.selector, {"sort": cursor.sort, "skip": cursor.skip, "limit": cursor.limit}, cursor.to_df().semanticHash(), time.monotonic() - began)

    def table(self) -> DataFrame:
        return self.spark.createDataFrame([(*k, *v) for k, v in self.rows.items()], SCHEMA)
