import datetime as dt

import pytest
from pyspark.sql import functions as F

from isochron.plans import stores
from isochron.streaming import readings as stream
from isochron.streaming import replay


def test_store_keeps_its_state(spark, tmp_path):
    rows = [(1, dt.datetime(2025, 1, 1, h), p, 2.0) for h, p in [(0, 0.0), (1, 30.0), (2, 0.0)]]
    spark.createDataFrame(rows, "k int, ts timestamp, rain double, et0 double").coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("k int, ts timestamp, rain double, et0 double").parquet(str(tmp_path / "in"))
    q = stream.running_store(source, "k", 12.0, 2.0, 22.0).writeStream.format("memory").queryName("stores").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [(r.store, r.outflow) for r in spark.sql("SELECT * FROM stores ORDER BY ts").collect()] == [(12.0, 0.0), (22.0, 19.0), (20.0, 0.0)]


def test_windows_of_a_batch(spark):
    rows = [(1, dt.datetime(2025, 1, 1, 0, m), 1.0) for m in (0, 10, 50)]
    df = spark.createDataFrame(rows, "k int, ts timestamp_ntz, value double")
    assert [r.n for r in stream.sessions(df, ["k"], "30 minutes").orderBy("start").collect()] == [2, 1]
    assert stream.complete_days(df, ["k"]).first().total == 3.0
    assert stream.sliding(df, ["k"]).count() == 5
    assert stream.days_of_hours(stream.complete_days(df, ["k"]), ["k"], rows=3).count() == 1


KIND = "k int, ts timestamp, rain double, et0 double"


def steps_of(spark, keys, n, seed=0):
    rows = spark.range(n).crossJoin(spark.range(keys).withColumnRenamed("id", "k"))  # a fixture of known size
    rain = (F.pmod(F.xxhash64(F.lit(seed), "id", "k"), F.lit(90)) / 10).alias("rain")
    return rows.select(F.col("k").cast("int"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 3600).alias("ts"), rain, (F.col("id") % 7 / 2.0).alias("et0"))


@pytest.mark.parametrize(("seed", "batches"), [(1, 2), (9, 5)])
def test_late_steps_are_folded_in_order(spark, seed, batches):
    steps = steps_of(spark, 3, 60)
    source = replay.replayed(steps, "ts", seed, 12, batches, 72)
    found = replay.drained(stream.store_in_order(source, "k", 12.0, 2.0, 22.0, "72 hours"))
    wanted = stores.bucket_series(steps, ["k"], "ts", "rain", "et0", F.lit(12.0), F.lit(2.0), F.lit(22.0))
    assert found.count() == 180
    assert found.drop("step").exceptAll(wanted.select("k", "ts", "store", "outflow", "loss")).count() == 0
    assert sorted(r.step for r in found.where("k = 1").collect()) == list(range(60))


def test_keys_share_groups(spark):
    steps = steps_of(spark, 30, 40).withColumn("k", F.concat(F.lit("s"), "k"))
    found = replay.drained(stream.store_in_order(replay.replayed(steps, "ts", 2, 12, 3, 72), "k", 12.0, 2.0, 22.0, "72 hours", groups=4))
    wanted = stores.bucket_series(steps, ["k"], "ts", "rain", "et0", F.lit(12.0), F.lit(2.0), F.lit(22.0))
    assert found.count() == 1200 and found.drop("step").exceptAll(wanted.select("k", "ts", "store", "outflow", "loss")).count() == 0


def test_the_batches_are_out_of_order(spark):
    source = replay.replayed(steps_of(spark, 1, 60), "ts", 1, 12, 3, 72)
    q = source.select("ts").writeStream.format("memory").queryName("arrivals").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("arrivals").count() == 61  # and the heartbeat
    assert len(q.recentProgress) >= 4
    with pytest.raises(ValueError, match="late_hours"):
        replay.replayed(steps_of(spark, 1, 60), "ts", 1, 12, 3, 13)


def appended(spark, path, rows):
    spark.createDataFrame(rows, KIND).coalesce(1).write.mode("append").parquet(path)


def test_what_waits_what_is_late_and_what_ties(spark, tmp_path):
    path, at = str(tmp_path / "in"), lambda h: dt.datetime(2025, 1, 1) + dt.timedelta(hours=h)
    appended(spark, path, [(1, at(5), 1.0, 0.0), (1, at(0), 0.0, 0.0)])
    appended(spark, path, [(1, at(3), 30.0, 0.0), (1, at(3), 2.0, 0.0), (2, at(20), 0.0, 0.0)])  # moves the clock to 18:00
    appended(spark, path, [(2, at(19), 0.0, 0.0)])  # the first batch that sees it
    appended(spark, path, [(1, at(4), 99.0, 0.0), (1, at(19), 0.0, 2.0)])  # the first is later than the watermark
    appended(spark, path, [(None, at(40), None, None)])
    source = spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(path)
    found = replay.drained(stream.store_in_order(source, "k", 12.0, 2.0, 22.0, "2 hours")).orderBy("k", "step").collect()
    assert [(r.k, r.ts.hour, r.step, r.store, r.outflow) for r in found] == [(1, 0, 0, 12.0, 0.0), (1, 3, 1, 14.0, 0.0), (1, 3, 2, 22.0, 22.0), (1, 5, 3, 22.0, 1.0), (1, 19, 4, 20.0, 0.0), (2, 19, 0, 12.0, 0.0), (2, 20, 1, 12.0, 0.0)]


def test_site_days_across_clock_changes(spark):
    hours = spark.sql("SELECT explode(sequence(TIMESTAMP_NTZ'2025-03-28 23:00:00', TIMESTAMP_NTZ'2025-03-31 21:00:00', INTERVAL 30 MINUTE)) AS ts UNION ALL SELECT explode(sequence(TIMESTAMP_NTZ'2025-10-25 22:00:00', TIMESTAMP_NTZ'2025-10-26 22:30:00', INTERVAL 30 MINUTE))")
    rows = hours.where("ts NOT IN (TIMESTAMP_NTZ'2025-03-31 10:00:00', TIMESTAMP_NTZ'2025-03-31 10:30:00')").select(F.lit("a").alias("k"), "ts", F.lit(1.0).alias("value"))
    stream_rows = replay.replayed(rows.withColumn("ts", F.col("ts").cast("timestamp")), "ts", 3, 1, 4, 24 * 80)
    days = replay.drained(stream.site_days(stream_rows, ["k"], per_hour=2, late=f"{24 * 80} hours")).orderBy("d").collect()
    assert [(str(r.d), r.hours, r.hours_of_day, r.readings, r.complete) for r in days] == [
        ("2025-03-29", 24, 24, 48, True), ("2025-03-30", 23, 23, 46, True), ("2025-03-31", 22, 24, 45, False), ("2025-10-26", 25, 25, 50, True),
    ]


def test_empty_record(spark):
    none = steps_of(spark, 1, 5).where("k > 5")
    assert replay.drained(stream.store_in_order(replay.replayed(none, "ts", 1, 1, 2, 48), "k", 1.0, 0.0, 2.0)).count() == 0


def test_bucket_as_a_table_function(spark):
    steps = steps_of(spark, 4, 50).withColumn("site", F.concat(F.lit("s "), "k")).withColumn("cap", 20.0 + F.col("k"))
    of = ["k", "site"], "ts", "rain", "et0", F.lit(8.0), F.lit(2.0), F.col("cap")
    scan, fold = stores.bucket_scan(steps, *of), stores.bucket_series(steps, *of)
    assert scan.columns == ["k", "site", "ts", "store", "outflow", "loss"]
    assert scan.count() == 200 and scan.exceptAll(fold).count() == 0
    spark.udtf.register("bucket_fold", stores.bucket_fold)
    sql = "SELECT * FROM bucket_fold(TABLE({t}), 'k', 'ts', rain => 'rain', et0 => 'et0', initial => 8.0, residual => 2, capacity => 'cap')"
    assert spark.sql(sql, t=steps).exceptAll(fold.drop("site")).count() == 0
    assert spark.sql(sql, t=steps.limit(0)).count() == 0
    with pytest.raises(Exception, match="no such columns"):
        spark.sql(sql.replace("'cap'", "'depth'"), t=steps)
    plan = scan._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


def test_site_days_replay_only_what_they_need(spark, monkeypatch):
    from isochron import queries_streams

    seen = []
    monkeypatch.setattr(queries_streams.replay, "replayed", lambda rows, *_: seen.append(rows.columns) or rows)
    monkeypatch.setattr(queries_streams.replay, "drained", lambda out: out)
    assert queries_streams.stream_site_days(spark, "/root/testdata/sf0.001").count() > 0
    assert seen == [["event_type", "ts", "value"]]
