"""A content-addressed cache of responses as a table: lookup, read-through fill, re-keying by day."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def request_key(*fields: str) -> Column:
    """SHA-256 of the request as JSON with sorted keys and without blanks."""
    return F.sha2(F.to_json(F.struct(*sorted(fields))), 256)


def lookup(requests: DataFrame, cache: DataFrame, key: str = "key") -> tuple[DataFrame, DataFrame]:
    """Requests with their responses, and those without."""
    return requests.join(cache, key), requests.join(cache.select(key), key, "left_anti")


def fetch_many(requests: DataFrame, cache: DataFrame, fill: Callable[[DataFrame], DataFrame], order: str, key: str = "key") -> DataFrame:
    """Responses of all requests in order: cached ones, and what ``fill`` gives for the rest (key, response)."""
    _, missing = lookup(requests, cache, key)
    every = cache.select(key, "response").unionByName(fill(missing.select(key).distinct()).select(key, "response"))
    return requests.join(every, key, "left").orderBy(order)


def append(cache_path: str, entries: DataFrame, key: str = "key") -> None:
    """Adds entries whose keys are new; the committer makes it all or nothing."""
    known = entries.sparkSession.read.parquet(cache_path).select(key)
    entries.dropDuplicates([key]).join(known, key, "left_anti").write.mode("append").parquet(cache_path)


def day_entries(entries: DataFrame) -> DataFrame:
    """Entries of ranges (site, data array<struct<day, ...>>) as one row per site and day: site, day, row, conflict if several differ."""
    days = entries.select("site", F.explode("data").alias("row")).select("site", F.col("row.day").alias("day"), "row")
    return days.groupBy("site", "day").agg(F.min("row").alias("row"), (F.count_distinct(F.sha2(F.to_json("row"), 256)) > 1).alias("conflict"))


def missing_ranges(wanted: DataFrame, cached: DataFrame, keys: list[str], day: str = "d") -> DataFrame:
    """Days that are not cached, as runs of consecutive days: one request each."""
    from isochron.operators.islands import day_runs

    return day_runs(wanted.join(cached.select(*keys, day), [*keys, day], "left_anti"), keys, day)


def weather_rows(responses: DataFrame, fields: list[str], radiation: str = "gs") -> DataFrame:
    """Responses with parallel arrays (daily.time, daily.<field>) as one row per day; radiation comes in MJ/m² and is made J/cm².

    Windows in which any value is null give no row at all: half a window is none.
    """
    zipped = F.explode(F.arrays_zip(*(F.col(f"daily.{f}").alias(f) for f in ["time", *fields])))
    whole = F.lit(True)
    for f in fields:
        whole = whole & ~F.exists(f"daily.{f}", lambda x: x.isNull())
    rows = responses.where(whole).select("site", zipped.alias("r"))
    value = lambda f: (F.col(f"r.{f}") * 100 if f == radiation else F.col(f"r.{f}")).alias(f)
    return rows.select("site", F.to_date("r.time").alias("d"), *(value(f) for f in fields))


def station_or_archive(station: DataFrame, archive: DataFrame, keys: list[str], days: int, day: str = "d") -> DataFrame:
    """The station's days where it has all ``days`` of the window, else the archive's, never a mix: a column source tells."""
    full = station.groupBy(*keys).agg(F.count_distinct(day).alias("__n")).where(F.col("__n") == days).select(*keys)
    own = station.join(full, keys, "left_semi").withColumn("source", F.lit("station"))
    other = archive.join(full, keys, "left_anti").withColumn("source", F.lit("archive"))
    return own.unionByName(other)
