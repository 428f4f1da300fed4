"""Aggregates over readings and days."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from isochron.functions.timeaxis import ROWS_PER_DAY, site_day, within_site_days
from isochron.functions.units import fold, half_hours_to_joule, ms_to_kmh, sum_in_order, valid_mean


def period_total(readings: DataFrame, start: dt.date, end: dt.date, keys: list[str] | None = None, ts: str = "ts", value: str = "value") -> DataFrame:
    """Sum and count of the readings of site days ``start`` to ``end``. No readings: total is null and readings 0; zeros give 0."""
    rows = readings.where(within_site_days(ts, start, end))
    return rows.groupBy(*(keys or [])).agg(F.sum(value).alias("total"), F.count(value).alias("readings"))


def daily(readings: DataFrame, kind: str, keys: list[str] | None = None, ts: str = "ts", value: str = "value", order: list[str] | None = None) -> DataFrame:
    """Per site day (d) and keys: value (sum of a flux, mean of a state) and readings; nulls don't count. ``order``: values are added as floats in this order, else exactly."""
    rows, by, folded = readings.where(F.col(value).isNotNull()).withColumn("d", site_day(ts)), [*(keys or []), "d"], fold(kind, value)
    if order:
        rows = rows.withColumn("__sum", sum_in_order(value, by, order))
        folded = F.first("__sum") if kind == "flux" else F.first("__sum") / F.count("*")
    return rows.groupBy(*by).agg(folded.alias("value"), F.count("*").alias("readings"))


def days_above(readings: DataFrame, threshold: float, keys: list[str] | None = None, ts: str = "ts", value: str = "value") -> DataFrame:
    """Number of site days whose highest reading is above ``threshold`` (days, not readings): days_above, days."""
    per_day = readings.withColumn("d", site_day(ts)).groupBy(*(keys or []), "d").agg(F.max(value).alias("top"))
    return per_day.groupBy(*(keys or [])).agg(F.count_if(F.col("top") > threshold).alias("days_above"), F.count("*").alias("days"))


def occurred(readings: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Whether the sum is above zero: occurred; null (no answer) where all readings are null."""
    return readings.groupBy(*keys).agg((F.sum(value) > 0).alias("occurred"), F.count(value).alias("readings"))


def peak_day(readings: DataFrame, keys: list[str], kind: str = "flux", ts: str = "ts", value: str = "value", order: list[str] | None = None) -> DataFrame:
    """The day with the highest total per keys: d, value, ties (days that share it); a tie names no day. ``order`` is that of ``daily``."""
    days = daily(readings, kind, keys, ts, value, order)
    best = days.withColumn("__k", F.rank().over(W.partitionBy(*keys).orderBy(F.desc("value")))).where("__k = 1")
    best = best.groupBy(*keys).agg(F.max("value").alias("value"), F.max("d").alias("d"), F.count("*").alias("ties"))
    return best.select(*keys, F.when(F.col("ties") == 1, F.col("d")).alias("d"), "value", "ties")


def station_days(weather: DataFrame, ts: str = "ts", rows_per_day: int = ROWS_PER_DAY, keys: list[str] | None = None) -> DataFrame:
    """Daily weather of a station's complete days, from half-hourly tmean, tmax, rh, rain, wind (m/s), rad (W/m²).

    Columns d, tm, tx, tn, rf, precip, w, gs. A day counts if it has ``rows_per_day`` rows (days with
    a clock change never have) and a wind reading that is no sentinel.
    """
    rows = weather.withColumn("d", site_day(ts))
    agg = rows.groupBy(*(keys or []), "d").agg(
        F.avg("tmean").alias("tm"), F.max("tmax").alias("tx"), F.min(2 * F.col("tmean") - F.col("tmax")).alias("tn"), F.avg("rh").alias("rf"),
        F.sum("rain").alias("precip"), ms_to_kmh(valid_mean("wind")).alias("w"), half_hours_to_joule(F.sum("rad")).alias("gs"), F.count("*").alias("__rows"),
    )
    return agg.where((F.col("__rows") == rows_per_day) & F.col("w").isNotNull()).drop("__rows")


def record_bounds(rows: DataFrame, at: str, value: str, keys: list[str] | None = None) -> DataFrame:
    """First and last instant with a value: first_at, last_at."""
    return rows.where(F.col(value).isNotNull()).groupBy(*(keys or [])).agg(F.min(at).alias("first_at"), F.max(at).alias("last_at"))


def buckets(days: DataFrame, size: int, ops: dict[str, str], keys: list[str] | None = None, day: str = "d") -> DataFrame:
    """Buckets of ``size`` days counted by position from each key's first day: start, end, days, one column per op.

    ``ops``: column to mean, max, min or sum; nulls are skipped. The last bucket may be short.
    """
    fns = {"mean": F.avg, "max": F.max, "min": F.min, "sum": F.sum}
    order = W.partitionBy(*(keys or [F.lit(0)])).orderBy(day)
    rows = days.withColumn("bucket", F.floor((F.row_number().over(order) - 1) / size))
    return rows.groupBy(*(keys or []), "bucket").agg(F.min(day).alias("start"), F.max(day).alias("end"), F.count("*").alias("days"), *(fns[op](c).alias(c) for c, op in ops.items()))


def series_stats(points: DataFrame, keys: list[str], kind: str, at: str = "d", value: str = "value") -> DataFrame:
    """points, first, last, lowest, highest, mean, total (of a flux) per series, to 3 digits."""
    c = F.col(value)
    return points.where(c.isNotNull()).groupBy(*keys).agg(
        F.count("*").alias("points"), F.round(F.min_by(c, at), 3).alias("first"), F.round(F.max_by(c, at), 3).alias("last"), F.round(F.min(c), 3).alias("lowest"),
        F.round(F.max(c), 3).alias("highest"), F.round(F.avg(c), 3).alias("mean"), (F.round(F.sum(c), 3) if kind == "flux" else F.lit(None).cast("double")).alias("total"),
    )


def retention(days: DataFrame, keys: list[str], rain: str = "rain", out: str = "outflow") -> DataFrame:
    """rain_total, out_total (null counts as 0), retained, retained_pct; the share is null without rain or outside 0 to 1."""
    sums = days.groupBy(*keys).agg(F.sum(rain).alias("rain_total"), F.sum(F.coalesce(out, F.lit(0.0))).alias("out_total"))
    share = F.try_divide(F.col("rain_total") - F.col("out_total"), "rain_total")
    return sums.withColumn("retained", F.col("rain_total") - F.col("out_total")).withColumn("retained_pct", F.when(share.between(0, 1), share * 100))


def deviations(pairs: DataFrame, model: str, measured: str, keys: list[str] | None = None) -> DataFrame:
    """n, mae, max_abs, rmse, bias, r of two columns, over rows that have both."""
    both = pairs.where(F.col(model).isNotNull() & F.col(measured).isNotNull())
    d = F.col(model) - F.col(measured)
    return both.groupBy(*(keys or [])).agg(F.count("*").alias("n"), F.avg(F.abs(d)).alias("mae"), F.max(F.abs(d)).alias("max_abs"), F.sqrt(F.avg(d * d)).alias("rmse"), F.avg(d).alias("bias"), F.corr(model, measured).alias("r"))


def class_balance(rows: DataFrame, value: str, thresholds: list[float]) -> DataFrame:
    """Per threshold how many values are above, at or below it, and whether both classes occur."""
    asked = F.explode(F.array(*map(F.lit, thresholds)))
    long = rows.where(F.col(value).isNotNull()).select(value, asked.alias("threshold"))
    out = long.groupBy("threshold").agg(F.count_if(F.col(value) > F.col("threshold")).alias("above"), F.count_if(F.col(value) <= F.col("threshold")).alias("not_above"))
    return out.withColumn("both", (F.col("above") > 0) & (F.col("not_above") > 0))


def lag_correlation(a: DataFrame, b: DataFrame, steps: list[int], minutes: int, ts: str = "ts", value: str = "value") -> DataFrame:
    """Correlation of a at t with b at t + step * minutes: step, r, n. Each side is shifted and joined by equality."""
    shifted = b.select(F.explode(F.array(*map(F.lit, steps))).alias("step"), F.col(ts).alias("__ts"), F.col(value).alias("__b"))
    shifted = shifted.withColumn("__ts", F.col("__ts") - F.make_dt_interval(mins=F.col("step") * minutes))
    joined = a.select(F.col(ts).alias("__ts"), F.col(value).alias("__a")).join(shifted, "__ts")
    return joined.groupBy("step").agg(F.corr("__a", "__b").alias("r"), F.count("*").alias("n"))


def percentiles(rows: DataFrame, value: str, keys: list[str], shares: list[float]) -> DataFrame:
    """Linear percentiles p50, p95 and so on, and max, per keys."""
    return rows.groupBy(*keys).agg(*(F.percentile(value, F.lit(s)).alias(f"p{round(s * 100)}") for s in shares), F.max(value).alias("max"))


def nearest_rank(rows: DataFrame, value: str, keys: list[str], share: float) -> DataFrame:
    """The smallest value that at least ``share`` of the values do not exceed."""
    return rows.groupBy(*keys).agg(F.expr(f"percentile_disc({share}) WITHIN GROUP (ORDER BY {value})").alias("nearest_rank"))


def cost_rollup(rows: DataFrame, keys: list[str], amount: str) -> DataFrame:
    """Sums and counts over all prefixes of ``keys``; level is the number of keys rolled up."""
    return rows.rollup(*keys).agg(F.sum(amount).alias("amount"), F.count("*").alias("n"), F.grouping_id().alias("gid"))
