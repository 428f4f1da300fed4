"""Delimited sensor files: semicolons, decimal commas, two null tokens, repeated timestamps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def number(text: Column) -> Column:
    """A double of text with a decimal comma; ``NA``, blanks and what is no number give null."""
    t = F.trim(text)
    return F.when(~t.isin("NA", ""), F.replace(t, F.lit(","), F.lit(".")).try_cast("double"))


def sanitised(name: str) -> str:
    """A column name without dots and trailing underscores."""
    return name.replace(".", "_").rstrip("_")


def read_delimited(spark: SparkSession, path: str, time_column: str, drop_prefixes: tuple[str, ...] = (), time_format: str = "yyyy-MM-dd HH:mm:ss", separator: str = ";") -> DataFrame:
    """A file or folder as timestamp and doubles; columns with one of the prefixes are left out. All is read as text, nothing is inferred."""
    raw = spark.read.csv(path, sep=separator, header=True, inferSchema=False)
    kept = [c for c in raw.columns if c != time_column and not c.startswith(drop_prefixes or ("\0",))]
    return raw.select(F.try_to_timestamp(F.col(f"`{time_column}`"), F.lit(time_format)).cast("timestamp_ntz").alias("timestamp"), *(number(F.col(f"`{c}`")).alias(sanitised(c)) for c in kept))


def median_by_timestamp(table: DataFrame, ts: str = "timestamp") -> DataFrame:
    """One row per timestamp with the median of each column; for tables that repeat timestamps."""
    return table.groupBy(ts).agg(*(F.median(c).alias(c) for c in table.columns if c != ts))


def profile(table: DataFrame, ts: str = "timestamp") -> DataFrame:
    """rows and distinct timestamps."""
    return table.agg(F.count("*").alias("rows"), F.count_distinct(ts).alias("timestamps"))


def ingest(table: DataFrame, path: str, ts: str = "timestamp", zone: str = "Europe/Berlin") -> None:
    """Writes a table as Parquet, partitioned by the month of the site's day, so that ranges of days prune files."""
    from isochron.functions.timeaxis import site_ts

    table.withColumn("site_month", F.date_format(site_ts(ts, zone), "yyyy-MM")).repartition("site_month").write.mode("overwrite").partitionBy("site_month").parquet(path)
