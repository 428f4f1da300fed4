"""Queries that run as streams over the driver's tables, and recurrences in SQL: the record comes again in batches out of order, and the result must be that of the whole record."""

from __future__ import annotations

from pyspark.sql import functions as F

from isochron.plans import stores
from isochron.queries import _STEPS, DAY, daily_by_user, day, events, query, r, store_steps
from isochron.streaming import readings, replay

#: Rows come up to three days after their time; a watermark of 15 days covers that and a batch of the record.
_SPREAD, _BATCHES, _LATE = 72, 3, 360


def _replayed(rows, seed: int):
    return replay.replayed(rows, "ts", seed, _SPREAD, _BATCHES, _LATE)


@query(f"WITH RECURSIVE {_STEPS} SELECT user_id, i, round(store, 5) AS store, round(outflow, 5) AS outflow, round(loss, 5) AS loss FROM f")
def stream_store(spark, sf_dir):
    d = daily_by_user(spark, sf_dir)
    steps = d.select("user_id", F.col("d").cast("timestamp").alias("ts"), (F.col("value") / 20).alias("rain"), (F.col("top") / 40).alias("et0"))
    out = replay.drained(readings.store_in_order(_replayed(steps, 1), "user_id", 8.0, 2.0, 20.0, f"{_LATE} hours"))
    return out.select("user_id", F.col("step").alias("i"), *(r(c, 5).alias(c) for c in ("store", "outflow", "loss")))


@query(f"""
    WITH h AS (SELECT event_type, {DAY} AS d, date_trunc('hour', ts) AS hour, sum(value) AS total, count(value) AS n FROM events GROUP BY ALL),
    g AS (SELECT event_type, d, sum(total) AS total, CAST(sum(n) AS BIGINT) AS readings, count(*) FILTER (WHERE n >= 1) AS hours FROM h GROUP BY ALL)
    SELECT *, hours = hours_of_day AS complete FROM (SELECT event_type, CAST(d AS VARCHAR) AS d, round(total, 4) AS total, readings, hours,
        CAST(epoch(CAST(d + 1 AS TIMESTAMP) AT TIME ZONE 'Europe/Berlin') - epoch(CAST(d AS TIMESTAMP) AT TIME ZONE 'Europe/Berlin') AS INTEGER) // 3600 AS hours_of_day FROM g)
""")
def stream_site_days(spark, sf_dir):
    out = replay.drained(readings.site_days(_replayed(events(spark, sf_dir).select("event_type", "ts", "value"), 2), ["event_type"], late=f"{_LATE} hours"))
    return out.select("event_type", day(), r("total").alias("total"), "readings", "hours", "hours_of_day", "complete")


@query("""
    WITH e AS (SELECT user_id, ts, coalesce(ts > lag(ts) OVER w + INTERVAL 12 HOUR, true) AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT *, sum(CAST(fresh AS INT)) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
    SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, strftime(max(ts) + INTERVAL 12 HOUR, '%Y-%m-%d %H:%M:%S') AS "end", count(*) AS n FROM s GROUP BY user_id, k
""")
def stream_sessions(spark, sf_dir):
    out = replay.drained(readings.sessions(_replayed(events(spark, sf_dir), 3), ["user_id"], "12 hours", late=f"{_LATE} hours"))
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return out.select("user_id", text("start"), text("end"), "n")


@query("""
    WITH w AS (SELECT event_type, value, time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE * unnest([0, 1, 2, 3]) AS start FROM events)
    SELECT event_type, strftime(start, '%Y-%m-%d %H:%M') AS start, round(avg(value), 4) AS mean, count(*) AS n FROM w GROUP BY ALL
""")
def stream_sliding(spark, sf_dir):
    out = replay.drained(readings.sliding(_replayed(events(spark, sf_dir), 4), ["event_type"], late=f"{_LATE} hours"))
    return out.select("event_type", F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), r("mean").alias("mean"), "n")


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_first_only(spark, sf_dir):
    out = replay.drained(readings.first_only(_replayed(events(spark, sf_dir), 5), ["user_id", "event_type"], late="1440 hours"))
    return out.where("user_id IS NOT NULL").select("user_id", "event_type")


@query(f"WITH RECURSIVE {_STEPS} SELECT user_id, i, round(store, 5) AS store, round(outflow, 5) AS outflow, round(loss, 5) AS loss FROM f")
def bucket_fold_sql(spark, sf_dir):
    spark.udtf.register("bucket_fold", stores.bucket_fold)
    return spark.sql(
        """SELECT user_id, i, round(store, 5) AS store, round(outflow, 5) AS outflow, round(loss, 5) AS loss
           FROM bucket_fold(TABLE({steps}), 'user_id', 'i', rain => 'p', et0 => 'e', initial => 8.0, residual => 2.0, capacity => 20.0)""",
        steps=store_steps(spark, sf_dir),
    )
