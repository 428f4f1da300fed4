import datetime as dt

import pytest
from pyspark.sql import functions as F

from isochron.functions import timeaxis
from isochron.operators import aggregates

NTZ = "ts timestamp_ntz, value double"


def readings(spark, rows):
    return spark.createDataFrame([(dt.datetime.fromisoformat(t), v) for t, v in rows], NTZ)


def test_days_are_the_sites(spark):
    df = readings(spark, [("2025-06-30 22:30", 1.0), ("2025-07-15 12:00", 2.5), ("2025-07-31 22:30", 4.0)])
    start, end = timeaxis.month_of("2025-07")
    assert aggregates.period_total(df, start, end).first().total == 3.5


def test_hot_days_count_days_not_rows(spark):
    df = readings(spark, [("2025-07-01 12:00", 33.0), ("2025-07-01 13:00", 32.0), ("2025-07-01 22:30", 31.0), ("2025-07-02 12:00", 25.0)])
    assert aggregates.days_above(df, 30.0).first().days_above == 2


def test_range_of_days_is_that_of_the_derived_day(spark):
    times = spark.range(0, 3 * 366 * 48).select((F.lit(dt.datetime(2024, 1, 1)).cast("timestamp_ntz") + F.make_dt_interval(mins=F.col("id") * 30)).alias("ts"))
    for a, b in [("2024-03-30", "2024-03-31"), ("2024-10-26", "2024-10-27"), ("2025-03-30", "2025-03-30")]:
        a, b = dt.date.fromisoformat(a), dt.date.fromisoformat(b)
        assert times.where(timeaxis.within_site_days("ts", a, b)).count() == times.where(timeaxis.site_day("ts").between(F.lit(a), F.lit(b))).count()


@pytest.mark.parametrize("day, rows", [("2025-03-30", 46), ("2025-10-26", 50), ("2025-07-01", 48)])
def test_days_with_a_clock_change(spark, day, rows):
    d = dt.date.fromisoformat(day)
    lo, hi = timeaxis.day_bounds_utc(d, d)
    assert (hi - lo).total_seconds() / 1800 == rows


def test_session_zone_does_not_count(spark):
    df = readings(spark, [("2025-06-30 22:30", 1.0)])
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "America/New_York", "Asia/Tokyo"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            assert df.select(timeaxis.site_day("ts").alias("d")).first().d == dt.date(2025, 7, 1)
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_pushed_to_the_scan(spark, tmp_path):
    readings(spark, [("2025-06-30 22:30", 1.0)]).write.parquet(str(tmp_path / "r"))
    df = spark.read.parquet(str(tmp_path / "r")).where(timeaxis.within_site_days("ts", dt.date(2025, 7, 1), dt.date(2025, 7, 2)))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts" in plan and "LessThan(ts" in plan


def test_windows():
    today = dt.date(2025, 7, 10)
    assert timeaxis.resolve_window(today) == (today, dt.date(2025, 7, 16))
    assert timeaxis.resolve_window(today, past_days=3) == (dt.date(2025, 7, 7), dt.date(2025, 7, 9))
    assert timeaxis.resolve_window(today, past_days=1, forecast_days=2) == (dt.date(2025, 7, 9), dt.date(2025, 7, 11))
    assert timeaxis.period_of("2025-02-01..2025-02-03") == (dt.date(2025, 2, 1), dt.date(2025, 2, 3))
    assert timeaxis.beyond_horizon(dt.date(2025, 7, 27), today) and not timeaxis.beyond_horizon(dt.date(2025, 7, 26), today)
    for bad in (dict(start=today), dict(start=today, end=today, past_days=1), dict(past_days=0), dict(start=today, end=dt.date(2025, 1, 1))):
        with pytest.raises(ValueError):
            timeaxis.resolve_window(today, **bad)
    for bad in ("2025-13", "July", "2025-02-03..2025-02-01"):
        with pytest.raises(ValueError):
            timeaxis.period_of(bad)
    with pytest.raises(ValueError):
        timeaxis.naive_utc(dt.datetime(2025, 1, 1))


def test_complete_days_only(spark):
    lo, hi = timeaxis.day_bounds_utc(dt.date(2025, 7, 1), dt.date(2025, 7, 2))
    rows, t = [], lo
    while t < hi:
        rows.append((t, 20.0, 22.0, 50.0, 0.5, -7999.0 if t.hour < 10 else 2.0, 100.0))
        t += dt.timedelta(minutes=30)
    df = spark.createDataFrame(rows[:-1], "ts timestamp_ntz, tmean double, tmax double, rh double, rain double, wind double, rad double")
    out = aggregates.station_days(df).collect()
    assert [(r.d, r.tm, r.tx, r.tn, r.precip, round(r.w, 6), r.gs) for r in out] == [(dt.date(2025, 7, 1), 20.0, 22.0, 18.0, 24.0, 7.2, 864.0)]
