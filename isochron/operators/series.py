"""Series of a closed vocabulary: which column of which table, how a day is made of readings, when it is too long to show."""

from __future__ import annotations

import dataclasses
import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isochron.functions.timeaxis import site_day, within_site_days
from isochron.functions.units import fold
from isochron.operators.aggregates import buckets

LONGEST_DAILY, BUCKET_DAYS = 31, 7


@dataclasses.dataclass(frozen=True)
class Variable:
    """A name that users may ask for: table, column, unit, and whether it is a flux (summed) or a state (averaged)."""

    name: str
    table: str
    column: str
    kind: str
    unit: str = ""
    measured: bool = True


def prepare(names: list[str], vocabulary: dict[str, Variable], start: dt.date, end: dt.date) -> tuple[list[Variable], str]:
    """The variables and the resolution: half-hourly only if all are measured. Refuses unknown names and reversed windows before any job."""
    unknown = [n for n in names if n not in vocabulary]
    if unknown or not names:
        raise ValueError(f"unknown variables: {unknown}; known: {sorted(vocabulary)}")
    if start > end:
        raise ValueError("window ends before it starts")
    chosen = [vocabulary[n] for n in dict.fromkeys(names)]
    return chosen, "half_hour" if all(v.measured for v in chosen) else "day"


def points(table: DataFrame, variable: Variable, start: dt.date, end: dt.date, resolution: str = "day", ts: str = "ts") -> DataFrame:
    """series, at, value of one variable: daily folds, or the raw readings. Nulls don't count."""
    rows = table.where(within_site_days(ts, start, end) & F.col(variable.column).isNotNull())
    if resolution == "half_hour":
        return rows.select(F.lit(variable.name).alias("series"), F.col(ts).cast("timestamp_ntz").alias("at"), F.col(variable.column).alias("value"))
    days = rows.groupBy(site_day(ts).alias("at")).agg(fold(variable.kind, variable.column).alias("value"))
    return days.select(F.lit(variable.name).alias("series"), "at", "value")


def gaps(days: DataFrame, keys: DataFrame, key: list[str], start: dt.date, end: dt.date, day: str = "d") -> DataFrame:
    """Per key: gap_days without a point in the window, and truncated: the last point is before its end.

    Missing days are missing rows, so they come from a spine of days for each of ``keys``.
    """
    spine = keys.select(*key).distinct().withColumn("__d", F.explode(F.sequence(F.lit(start), F.lit(end))))
    there = days.where(F.col(day).between(F.lit(start), F.lit(end))).select(*key, F.col(day).alias("__d"), F.lit(1).alias("__has")).distinct()
    return spine.join(there, [*key, "__d"], "left").groupBy(*key).agg(
        F.count_if(F.col("__has").isNull()).alias("gap_days"), F.coalesce(F.max(F.when(F.col("__has").isNotNull(), F.col("__d"))) < F.lit(end), F.lit(True)).alias("truncated")
    )


def shown(days: DataFrame, keys: list[str], ops: dict[str, str], n_days: int, day: str = "d") -> DataFrame:
    """Daily rows up to 31 days, buckets of 7 days for longer windows."""
    if n_days <= LONGEST_DAILY:
        return days.select(*keys, F.col(day).alias("start"), F.col(day).alias("end"), F.lit(1).cast("bigint").alias("days"), *ops)
    return buckets(days, BUCKET_DAYS, ops, keys, day).drop("bucket")


def as_points(long: DataFrame, keys: list[str]) -> DataFrame:
    """Each series as one row with points array<struct<at,value>> in order of time. For results: a series is one row."""
    return long.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("at", "value"))).alias("points"))


def capped(df: DataFrame, most: int = 100) -> tuple[list, bool]:
    """At most ``most`` rows and whether there are more; never fetches more than one beyond."""
    rows = df.limit(most + 1).collect()
    return rows[:most], len(rows) > most
