"""Data quality of requirements: coverage, gaps, plausibility, stuck sensors; all requirements in one pass over the readings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: What is enough.
POINT_ROWS, PERIOD_SHARE, LONGEST_GAP_H, FROZEN_RUN = 44, 0.95, 24.0, 24
STATE_TABLES = ("swc", "tsoil", "radiation")


def measure(readings: DataFrame, requirements: DataFrame, key: list[str], ts: str = "ts", value: str = "value") -> DataFrame:
    """What there is for each requirement: rows, max_gap_hours, level_min, level_max, longest_run.

    ``requirements``: req_id, ``key``, start_ts, end_ts (half-open). Gaps include the window's edges;
    without readings the whole window is a gap. A run counts equal readings in a row.
    """
    # requirements are unrolled to days, so that a reading meets those of its key and day only
    days = F.sequence(F.to_date("start_ts"), F.to_date("end_ts"))
    need = requirements.where("start_ts < end_ts").select("req_id", *key, "start_ts", "end_ts", F.explode(days).alias("__day"))
    rows = need.join(readings.select(*key, F.col(ts).alias("__ts"), F.col(value).alias("__v"), F.to_date(ts).alias("__day")), [*key, "__day"])
    rows = rows.where((F.col("__ts") >= F.col("start_ts")) & (F.col("__ts") < F.col("end_ts")) & F.col("__v").isNotNull())
    w = W.partitionBy("req_id").orderBy("__ts")
    hours = lambda a, b: F.timestamp_diff("MICROSECOND", a, b) / F.lit(3.6e9)
    rows = rows.withColumn("__gap", hours(F.lag("__ts").over(w), F.col("__ts")))
    rows = rows.withColumn("__new", F.coalesce((F.col("__v") != F.lag("__v").over(w)).cast("int"), F.lit(1))).withColumn("__run", F.sum("__new").over(w))
    runs = rows.groupBy("req_id", "__run").agg(F.count("*").alias("n"), F.max("__gap").alias("gap"), F.min("__v").alias("lo"), F.max("__v").alias("hi"), F.min("__ts").alias("first"), F.max("__ts").alias("last"))
    found = runs.groupBy("req_id").agg(F.sum("n").alias("rows"), F.max("gap").alias("gap"), F.min("lo").alias("level_min"), F.max("hi").alias("level_max"), F.max("n").alias("longest_run"), F.min("first").alias("first"), F.max("last").alias("last"))
    out = requirements.join(found, "req_id", "left")
    whole = hours(F.col("start_ts"), F.col("end_ts"))
    gap = F.when(F.col("rows").isNull(), whole).otherwise(F.greatest(F.coalesce("gap", F.lit(0.0)), hours(F.col("start_ts"), F.col("first")), hours(F.col("last"), F.col("end_ts"))))
    return out.withColumn("max_gap_hours", gap).withColumn("rows", F.coalesce("rows", F.lit(0))).withColumn("longest_run", F.coalesce("longest_run", F.lit(0))).drop("gap", "first", "last")


def judge(measured: DataFrame, per_day: int = 48) -> DataFrame:
    """A verdict for each measured requirement (kind, days, low, high, state): ok, and the first reason if not.

    point: at least 44 rows; period: 95 % of the rows and no gap beyond 24 h. Levels lie within low and
    high, where given. A state that repeats 24 times or more is stuck.
    """
    enough = F.when(F.col("kind") == "point", F.col("rows") >= POINT_ROWS).otherwise((F.col("rows") >= PERIOD_SHARE * per_day * F.col("days")) & (F.col("max_gap_hours") <= LONGEST_GAP_H))
    plausible = F.coalesce(F.col("level_min") >= F.col("low"), F.lit(True)) & F.coalesce(F.col("level_max") <= F.col("high"), F.lit(True))
    reason = F.when(~enough, "coverage").when(~plausible, "plausibility").when(F.col("state") & (F.col("longest_run") >= FROZEN_RUN), "frozen")
    return measured.withColumn("reason", reason).withColumn("ok", F.col("reason").isNull())
