"""As-of views: a set of Parquet tables as they were at an instant, under their own names in a session of their own."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isochron.functions.timeaxis import naive_utc


def bounded(table: DataFrame, as_of: dt.datetime, ts: str = "ts") -> DataFrame:
    """Rows at or before an aware instant; the bound reaches the scan."""
    return table.where(F.col(ts) <= F.lit(naive_utc(as_of)).cast("timestamp_ntz"))


class Scenario:
    """A clock and the views bound to it: ``paths`` names the table of each view.

    The views live in a new session, so scenarios don't see each other's. ``at`` moves the clock and
    rebinds the views when its day changes.
    """

    def __init__(self, spark: SparkSession, paths: dict[str, str], as_of: dt.datetime, ts: str = "ts"):
        self.spark, self.paths, self.as_of, self.ts = spark.newSession(), paths, as_of, ts
        self._bind()

    def _bind(self) -> None:
        for name, path in self.paths.items():
            bounded(self.spark.read.parquet(path), self.as_of, self.ts).createOrReplaceTempView(name)

    def at(self, as_of: dt.datetime) -> Scenario:
        if as_of.date() != self.as_of.date():
            self.as_of = as_of
            self._bind()
        return self

    def table(self, name: str) -> DataFrame:
        return self.spark.table(name)
