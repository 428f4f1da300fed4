"""Gaps and runs: lags, edges, islands of equal values, of days, of conditions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from isochron.functions.timeaxis import SITE_ZONE, site_day
from isochron.functions.units import exact_sum, sum_in_order


def gap_hours(ts: str, over) -> Column:
    """Hours since the row before."""
    return F.timestamp_diff("MICROSECOND", F.lag(ts).over(over), F.col(ts)) / F.lit(3.6e9)


def max_gap(readings: DataFrame, keys: list[str], start: dt.datetime, end: dt.datetime, ts: str = "ts") -> DataFrame:
    """The longest time without a reading in a window, its edges included: max_gap_hours. Keys without readings have no row here."""
    w = W.partitionBy(*keys).orderBy(ts)
    lo, hi = (F.lit(x).cast("timestamp_ntz") for x in (start, end))
    rows = readings.where((F.col(ts) >= lo) & (F.col(ts) < hi)).withColumn("__gap", gap_hours(ts, w))
    edge = lambda a, b: F.timestamp_diff("MICROSECOND", a, b) / F.lit(3.6e9)
    return rows.groupBy(*keys).agg(F.greatest(F.coalesce(F.max("__gap"), F.lit(0.0)), edge(lo, F.min(ts)), edge(F.max(ts), hi)).alias("max_gap_hours"))


def equal_runs(readings: DataFrame, keys: list[str], ts: str = "ts", value: str = "value") -> DataFrame:
    """Runs of equal values in a row: keys, value, start, end, length. One sort by keys and time."""
    w = W.partitionBy(*keys).orderBy(ts)
    changed = F.coalesce(~F.col(value).eqNullSafe(F.lag(value).over(w)) | (F.row_number().over(w) == 1), F.lit(True))
    rows = readings.withColumn("__new", changed.cast("int")).withColumn("__run", F.sum("__new").over(w))
    return rows.groupBy(*keys, "__run").agg(F.first(value).alias("value"), F.min(ts).alias("start"), F.max(ts).alias("end"), F.count("*").alias("length")).drop("__run")


def day_runs(days: DataFrame, keys: list[str], day: str = "d") -> DataFrame:
    """Runs of consecutive days: keys, start, end, length. Repeated days count once."""
    rows = days.select(*keys, F.col(day).alias("__d")).distinct()
    island = F.date_sub("__d", F.row_number().over(W.partitionBy(*keys).orderBy("__d")))
    return rows.withColumn("__i", island).groupBy(*keys, "__i").agg(F.min("__d").alias("start"), F.max("__d").alias("end"), F.count("*").alias("length")).drop("__i")


def wet_events(rain: DataFrame, keys: list[str], wet: float = 0.2, depth: float = 10.0, tail: int = 1, day: str = "d", value: str = "value", exact: bool = True) -> DataFrame:
    """Rain events: runs of wet days with ``tail`` days after, kept if ``depth`` mm fall in them: start, end, rain_total, days.

    Unless ``exact``, days are added as floats in their order.
    """
    runs = day_runs(rain.where(F.col(value) >= wet), keys, day).withColumn("end", F.date_add("end", tail))
    unrolled = runs.withColumn(day, F.explode(F.sequence("start", "end")))
    met, by, total = unrolled.join(rain.select(*keys, day, value), [*keys, day]), [*keys, "start", "end"], exact_sum(value)
    if not exact:
        met, total = met.withColumn("__sum", sum_in_order(value, by, [day])), F.first("__sum")
    sums = met.groupBy(*by).agg(total.alias("rain_total"), F.count("*").alias("days"))
    return sums.where(F.col("rain_total") >= depth)


def heat_days(tops: DataFrame, keys: list[str], start: dt.date, end: dt.date, hot: float = 24.0, least: int = 3, day: str = "d", value: str = "value") -> DataFrame:
    """Days of a window that lie in runs of at least ``least`` hot days: days_inside, days_across, answered.

    Inside counts runs cut at the window's edges, across counts them whole; where the two differ, a
    run crosses the edge so that the answer depends on the reading, and answered is false.
    """
    warm = tops.where(F.col(value) >= hot)
    window = F.col(day).between(F.lit(start), F.lit(end))
    inside = day_runs(warm.where(window), keys, day).where(F.col("length") >= least).groupBy(*keys).agg(F.sum("length").alias("days_inside"))
    across = day_runs(warm, keys, day).where(F.col("length") >= least)
    overlap = F.greatest(F.lit(0), F.date_diff(F.least("end", F.lit(end)), F.greatest("start", F.lit(start))) + 1)
    across = across.groupBy(*keys).agg(F.sum(overlap).alias("days_across"))
    out = tops.select(*keys).distinct().join(inside, keys, "left").join(across, keys, "left").fillna(0, ["days_inside", "days_across"])
    return out.withColumn("answered", F.col("days_inside") == F.col("days_across"))


def changes(rows: DataFrame, keys: list[str], at: str, value: str) -> DataFrame:
    """Rows with ``delta`` to the row before and ``changed`` (false on the first)."""
    w = W.partitionBy(*keys).orderBy(at)
    return rows.withColumn("delta", F.col(value) - F.lag(value).over(w)).withColumn("changed", F.coalesce(F.col(value) != F.lag(value).over(w), F.lit(False)))


def watered_days(days: DataFrame, keys: list[str], day: str = "d", theta: str = "theta", rain: str = "rain", rise: float = 1.0, dry: float = 0.5) -> DataFrame:
    """Days on which the water content rose by ``rise`` without rain: irrigation."""
    w = W.partitionBy(*keys).orderBy(day)
    return days.withColumn("delta", F.col(theta) - F.lag(theta).over(w)).where((F.col("delta") >= rise) & (F.col(rain) < dry))


def first_index(rows: DataFrame, keys: list[str], index: str, condition: Column, most: int) -> DataFrame:
    """The first index from 1 to ``most`` where a condition holds: first_at, null if none."""
    return rows.groupBy(*keys).agg(F.min(F.when(condition & F.col(index).between(1, most), F.col(index))).alias("first_at"))


def best_so_far(rows: DataFrame, keys: list[str], step: str, value: str) -> DataFrame:
    """Rows with the best value up to each step, and whether the last step is not the best one."""
    up = W.partitionBy(*keys).orderBy(step).rowsBetween(W.unboundedPreceding, 0)
    every = W.partitionBy(*keys)
    out = rows.withColumn("best", F.max(value).over(up))
    return out.withColumn("best_not_last", F.max(value).over(every) > F.max_by(value, step).over(every) + 1e-9)


def event_table(events: DataFrame, readings: DataFrame, keys: list[str], outflows: list[str], per_day: int, ts: str = "ts", value: str = "value", zone: str = SITE_ZONE) -> DataFrame:
    """Of each event (keys, start, end: site days, both included): rain, rows, coverage (rows by the rows that its days should have), max_gap_h, and the sum of each column of ``outflows``.

    ``readings``: keys, ts, value (rain) and the outflows. Events are unrolled to days and meet readings by key and day. Gaps are those between readings of
    the event; with fewer than two there is none. Events without readings have zero rows and no sums.
    """
    unrolled = events.select(*keys, "start", "end", F.explode(F.sequence("start", "end")).alias("__d"))
    met = unrolled.join(readings.withColumn("__d", site_day(ts, zone)), [*keys, "__d"], "left")
    gap = gap_hours(ts, W.partitionBy(*keys, "start", "end").orderBy(ts))
    days = F.date_diff("end", "start") + 1
    return met.withColumn("__gap", gap).groupBy(*keys, "start", "end").agg(
        F.sum(value).alias("rain"), F.count(ts).alias("rows"), (F.count(ts) / (F.first(days) * per_day)).alias("coverage"), F.max("__gap").alias("max_gap_h"), *(F.sum(c).alias(c) for c in outflows)
    )
