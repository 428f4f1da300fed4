"""The catalog of questions: which query answers each kind, and the compositions that no single operator gives."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isochron.functions.units import exact_sum, sum_in_order

#: Question kind -> the query that shows it on the driver's tables.
ANSWERS = {
    "T01": "t01_total_by_period", "T02": "t02_hot_day_count", "T03": "t03_paired_gap", "T04": "t04_occurred", "T05": "t05_peak_day", "T06": "t06_one_threshold", "T07": "irrigation_ladder",
    "T08": "heatwave_days", "T09": "t09_store_below", "T10": "t10_lowest_store", "T11": "irrigation_ladder", "T12": "t12_event_retention", "T13": "t13_window_weather", "T14": "t13_window_weather",
    "T15a": "t15a_window_sum", "T15b": "t13_window_weather", "T16a": "t16_stated_ladder", "T16b": "t16_stated_ladder", "T17a": "t17_absent_parameters", "T17b": "t17_excluded_roofs",
    "T18a": "t18_not_served", "T18b": "t18_not_served", "T19": "t19_model_error", "T20": "t20_heatwave_expected", "T21": "what_if_rain", "T22": "t22_albedo", "T23": "t23_initial_store", "T24a": "pivot_diff",
    "T24b": "t03_paired_gap", "T25": "t25_two_routes", "T26": "t26_composed_overrides", "T27": "t27_not_modellable",
}


def one_value(rows: DataFrame, value: str, keys: list[str] | None = None) -> DataFrame:
    """The value that all rows (of each ``keys``) share: value, answered; a question about several that differ has no answer."""
    return rows.groupBy(*(keys or [])).agg(F.min(value).alias("value"), (F.count_distinct(value) == 1).alias("answered"))


def lowest(balanced: DataFrame, keys: list[str], depth_cm: float, at: str = "d") -> DataFrame:
    """Lowest water content (% by volume) of a modelled store and when it was: theta_min, at."""
    theta = F.col("store") * 100 / (depth_cm * 10)
    return balanced.groupBy(*keys).agg(F.min(theta).alias("theta_min"), F.min_by(at, F.struct(theta, F.col(at))).alias("at"))


def window_weather(days: DataFrame, keys: list[str], start: dt.date, end: dt.date, rain_over: float) -> DataFrame:
    """Of a window: rain_total, tmax, rainy (rain over a threshold), complete (a row for each day)."""
    rows = days.where(F.col("d").between(F.lit(start), F.lit(end)))
    return rows.groupBy(*keys).agg(F.sum("precip").alias("rain_total"), F.max("tx").alias("tmax"), (F.sum("precip") > rain_over).alias("rainy"), (F.count_distinct("d") == (end - start).days + 1).alias("complete"))


def missing_parameters(wanted: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """What is asked for and not documented: a reason to abstain."""
    return wanted.join(known, keys, "left_anti")


def agreed(a: DataFrame, b: DataFrame, keys: list[str], value: str, close: float = 1e-9) -> DataFrame:
    """keys, value, answered: the value of two routes to one answer, which stands only where both have it and agree (numbers within ``close``); keys that one route lacks are not answered."""
    both = a.select(*keys, F.col(value).alias("__a")).join(b.select(*keys, F.col(value).alias("__b")), keys, "full_outer")
    number = a.schema[value].dataType.typeName() in ("double", "float")
    same = F.coalesce(F.abs(F.col("__a") - F.col("__b")) <= close if number else F.col("__a") == F.col("__b"), F.lit(False))
    return both.select(*keys, F.when(same, F.col("__a")).alias("value"), same.alias("answered"))


def modellable(asked: DataFrame, roof: str, presets: DataFrame) -> DataFrame:
    """``asked`` with status: ``available`` where the roof has a preset, ``excluded`` where it is a known roof without one, ``unknown`` for other names. ``presets``: roof, has_model."""
    joined = asked.join(presets.withColumnRenamed("roof", roof), roof, "left")
    return joined.withColumn("status", F.when(F.col("has_model"), "available").when(F.col("has_model").isNotNull(), "excluded").otherwise("unknown")).drop("has_model")


def served(end: Column, as_of: dt.date, variable: Column, offered: list[str], horizon: int = 16) -> Column:
    """available, beyond_horizon or unknown_variable."""
    return F.when(end > F.lit(as_of + dt.timedelta(days=horizon)), "beyond_horizon").when(~variable.isin(offered), "unknown_variable").otherwise("available")


def event_retention(events: DataFrame, daily_out: DataFrame, keys: list[str], target: float = 0.5, exact: bool = True) -> DataFrame:
    """Share of each rain event that stayed (events: keys, start, end, rain_total; daily_out: keys, d, value), and whether it exceeds ``target``.

    Shares outside 0 to 1 have no answer: more flowed out than fell. Unless ``exact``, days are added as floats in their order.
    """
    days = events.withColumn("d", F.explode(F.sequence("start", "end")))
    met, by, flowed = days.join(daily_out, [*keys, "d"], "left"), [*keys, "start", "end", "rain_total"], F.coalesce("value", F.lit(0.0))
    total = exact_sum(flowed)
    if not exact:
        met, total = met.withColumn("__sum", sum_in_order(flowed, by, ["d"])), F.first("__sum")
    out = met.groupBy(*by).agg(total.alias("out_total"))
    share = F.try_divide(F.col("rain_total") - F.col("out_total"), "rain_total")
    return out.withColumn("share", F.when(share.between(0, 1), share)).withColumn("kept", F.col("share") > target)
