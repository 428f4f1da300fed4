"""Site time: readings carry naive UTC timestamps, days and hours are those of the site's calendar."""

from __future__ import annotations

import calendar
import datetime as dt
import re
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SITE_ZONE = "Europe/Berlin"
ROWS_PER_DAY = 48  # half-hourly readings of a day without a clock change


def site_ts(ts: str | Column, zone: str = SITE_ZONE) -> Column:
    """The site's wall clock at a naive UTC timestamp; independent of the session's time zone."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), F.col(ts) if isinstance(ts, str) else ts)


def site_day(ts: str | Column, zone: str = SITE_ZONE) -> Column:
    """The site's calendar day of a naive UTC timestamp."""
    return F.to_date(site_ts(ts, zone))


def site_hour(ts: str | Column, zone: str = SITE_ZONE) -> Column:
    """The site's wall clock, cut to the hour."""
    return F.date_trunc("hour", site_ts(ts, zone)).cast("timestamp_ntz")


def day_bounds_utc(start: dt.date, end: dt.date, zone: str = SITE_ZONE) -> tuple[dt.datetime, dt.datetime]:
    """Naive UTC instants of the site's midnight before ``start`` and after ``end`` (half-open)."""
    z = ZoneInfo(zone)
    at = lambda d: dt.datetime.combine(d, dt.time(), z).astimezone(dt.UTC).replace(tzinfo=None)
    return at(start), at(end + dt.timedelta(days=1))


def within_site_days(ts: str, start: dt.date, end: dt.date, zone: str = SITE_ZONE) -> Column:
    """The site day lies in ``start`` to ``end``, both included.

    Said as a range of the raw timestamp: the site's midnights in UTC. That is exact on days with a
    clock change, too, and reaches the Parquet scan, which a range of the derived day would not.
    """
    lo, hi = day_bounds_utc(start, end, zone)
    return (F.col(ts) >= F.lit(lo).cast("timestamp_ntz")) & (F.col(ts) < F.lit(hi).cast("timestamp_ntz"))


def naive_utc(instant: dt.datetime) -> dt.datetime:
    """A naive UTC datetime of an aware instant; naive ones are refused, as they would mean the host's zone."""
    if instant.tzinfo is None:
        raise ValueError("as-of needs a time zone")
    return instant.astimezone(dt.UTC).replace(tzinfo=None)


def month_of(text: str) -> tuple[dt.date, dt.date]:
    """First and last day of ``YYYY-MM``."""
    m = re.fullmatch(r"(\d{4})-(\d{2})", text.strip())
    if not m or not 1 <= int(m[2]) <= 12:
        raise ValueError(f"no month: {text!r}")
    y, n = int(m[1]), int(m[2])
    return dt.date(y, n, 1), dt.date(y, n, calendar.monthrange(y, n)[1])


def period_of(text: str) -> tuple[dt.date, dt.date]:
    """First and last day of a month ``YYYY-MM``, a day, or ``A..B`` (days, both included)."""
    ends = text.split("..")
    if len(ends) == 1:
        return month_of(text) if len(text.strip()) == 7 else (dt.date.fromisoformat(text.strip()),) * 2
    start, end = (dt.date.fromisoformat(x.strip()) for x in ends)
    if start > end:
        raise ValueError(f"period ends before it starts: {text!r}")
    return start, end


def resolve_window(today: dt.date, start: dt.date | None = None, end: dt.date | None = None, past_days: int | None = None, forecast_days: int | None = None) -> tuple[dt.date, dt.date]:
    """A window from absolute days or from counts of days, not both.

    past_days ends yesterday; forecast_days starts today; together they touch. Without any: seven days from today.
    """
    if (start is None) != (end is None):
        raise ValueError("start and end go together")
    if start is not None:
        if past_days is not None or forecast_days is not None:
            raise ValueError("absolute days or counts, not both")
        if start > end:
            raise ValueError("window ends before it starts")
        return start, end
    for n in (past_days, forecast_days):
        if n is not None and n < 1:
            raise ValueError("counts of days are positive")
    if past_days is None and forecast_days is None:
        forecast_days = 7
    first = today - dt.timedelta(days=past_days) if past_days else today
    last = today + dt.timedelta(days=forecast_days - 1) if forecast_days else today - dt.timedelta(days=1)
    return first, last


def beyond_horizon(end: dt.date, today: dt.date, days: int = 16) -> bool:
    """A window that ends later than forecasts reach."""
    return end > today + dt.timedelta(days=days)


def day_spine(spark: SparkSession, start: dt.date, end: dt.date) -> DataFrame:
    """One row per day: d. Both ends are included; an empty range gives no rows."""
    if start > end:
        return spark.createDataFrame([], "d date")
    return spark.range(1).select(F.explode(F.sequence(F.lit(start), F.lit(end))).alias("d"))


def complete_months(spark: SparkSession, first: dt.date, last: dt.date) -> DataFrame:
    """Months that lie in the range with all their days: month (YYYY-MM), start, end."""
    months = spark.range(1).select(F.explode(F.sequence(F.trunc(F.lit(first), "MM"), F.trunc(F.lit(last), "MM"), F.expr("interval 1 month"))).alias("start"))
    months = months.withColumn("end", F.last_day("start"))
    return months.where((F.col("start") >= F.lit(first)) & (F.col("end") <= F.lit(last))).select(F.date_format("start", "yyyy-MM").alias("month"), "start", "end")


def months_within(bounds: DataFrame, keys: list[str], first: str, last: str) -> DataFrame:
    """Months that lie in each row's range of days with all their days: keys, month (YYYY-MM), start, end. A range without days has none."""
    months = F.sequence(F.trunc(first, "MM"), F.trunc(last, "MM"), F.expr("interval 1 month"))
    rows = bounds.where(F.col(first) <= F.col(last)).select(*keys, first, last, F.explode(months).alias("start")).withColumn("end", F.last_day("start"))
    return rows.where((F.col("start") >= F.col(first)) & (F.col("end") <= F.col(last))).select(*keys, F.date_format("start", "yyyy-MM").alias("month"), "start", "end")


def stamp(col: str | Column, kind: str = "date") -> Column:
    """Fixed text of a day (YYYY-MM-DD) or an instant (YYYY-MM-DD HH:MM:SS)."""
    return F.date_format(col, "yyyy-MM-dd" if kind == "date" else "yyyy-MM-dd HH:mm:ss")
