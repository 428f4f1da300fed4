import datetime as dt
import json

from pyspark.sql import functions as F

from isochron.sources import asof, cache, delimited, records


def test_delimited(spark, tmp_path):
    (tmp_path / "a.txt").write_text("Date;T.x_;raw1;Rain\n2025-01-01 00:00:00;1,5;9;NA\n2025-01-01 00:00:00;2,5;9;\n2025-01-01 00:30:00;x;9;0,25\n")
    df = delimited.read_delimited(spark, str(tmp_path / "a.txt"), "Date", ("raw",))
    assert df.columns == ["timestamp", "T_x", "Rain"]
    out = delimited.median_by_timestamp(df).orderBy("timestamp").collect()
    assert [(r.T_x, r.Rain) for r in out] == [(2.0, None), (None, 0.25)]
    assert tuple(delimited.profile(df).first()) == (3, 2)
    delimited.ingest(df, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 3


def test_scenario(spark, tmp_path):
    rows = [(dt.datetime(2025, 1, d), float(d)) for d in range(1, 6)]
    spark.createDataFrame(rows, "ts timestamp_ntz, value double").write.parquet(str(tmp_path / "t"))
    s = asof.Scenario(spark, {"readings": str(tmp_path / "t")}, dt.datetime(2025, 1, 3, tzinfo=dt.UTC))
    assert s.spark.sql("SELECT count(*) FROM readings").first()[0] == 3
    assert not spark.catalog.tableExists("readings")
    assert s.at(dt.datetime(2025, 1, 5, tzinfo=dt.UTC)).table("readings").count() == 5


def test_cache(spark):
    requests = spark.createDataFrame([(0, "a"), (1, "b"), (2, "a")], "n int, key string")
    known = spark.createDataFrame([("a", "A")], "key string, response string")
    fill = lambda missing: missing.withColumn("response", F.upper("key"))
    assert [r.response for r in cache.fetch_many(requests, known, fill, "n").collect()] == ["A", "B", "A"]
    wanted = spark.createDataFrame([("s", dt.date(2025, 1, d)) for d in (1, 2, 3, 5)], "site string, d date")
    have = spark.createDataFrame([("s", dt.date(2025, 1, 2))], "site string, d date")
    assert sorted(r.length for r in cache.missing_ranges(wanted, have, ["site"]).collect()) == [1, 1, 1]


def test_weather_windows_are_whole_or_none(spark):
    schema = "site string, daily struct<time:array<string>,tm:array<double>,gs:array<double>>"
    df = spark.createDataFrame([("a", (["2025-01-01", "2025-01-02"], [1.0, 2.0], [3.0, 4.0])), ("b", (["2025-01-01"], [None], [1.0]))], schema)
    assert [tuple(r) for r in cache.weather_rows(df, ["tm", "gs"]).orderBy("d").collect()] == [("a", dt.date(2025, 1, 1), 1.0, 300.0), ("a", dt.date(2025, 1, 2), 2.0, 400.0)]


def test_records(spark, tmp_path):
    (tmp_path / "q.txt").write_text("1. How much?\n\n 2) When?\n")
    (tmp_path / "q.jsonl").write_text("\n".join(json.dumps({"question": q, "sql": "SELECT 1"}) for q in "ab"))
    assert [r.question for r in records.read_questions(spark, str(tmp_path / "q.txt"), "txt").collect()] == ["How much?", "When?"]
    assert records.question_column(records.read_questions(spark, str(tmp_path / "q.jsonl"), "jsonl"), True).where("asked = question").count() == 2


def test_ledger_counts_only_committed_attempts(spark, tmp_path):
    import pyarrow as pa
    import pytest

    from isochron.sources import ledger

    ledger.register(spark)
    path = str(tmp_path / "ledger")
    rows = spark.createDataFrame([(k, f"m{k % 2}", None if k == 3 else k / 2) for k in range(10)], "k int, served string, cost double").repartition(3)
    rows.write.format("ledger").mode("append").save(path)
    kind = spark.read.format("ledger").load(path).schema
    writer = ledger.LedgerWriter(path, kind)
    batch = lambda k: pa.RecordBatch.from_pylist([{"k": k, "served": "x", "cost": 1.0}], pa.schema([("k", pa.int32()), ("served", pa.string()), ("cost", pa.float64())]))
    lost, counted, failed = (writer.write(iter([batch(k)])) for k in (100, 100, 200))
    writer.commit([counted, None, writer.write(iter([]))])
    writer.abort([failed, None])
    back = spark.read.format("ledger").load(path)
    assert sorted(r.k for r in back.collect()) == [*range(10), 100]
    assert lost.name and not (tmp_path / "ledger" / failed.name).exists()
    assert back.where("cost IS NULL").count() == 1 and back.select("served").distinct().count() == 3
    with pytest.raises(Exception, match="other columns"):
        rows.drop("cost").write.format("ledger").mode("append").save(path)
    with pytest.raises(Exception, match="only appended"):
        rows.write.format("ledger").mode("overwrite").save(path)
    with pytest.raises(Exception, match="no ledger"):
        spark.read.format("ledger").load(str(tmp_path / "none"))


def test_global_numbers(spark):
    from isochron.operators.ranks import numbered

    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    df = spark.createDataFrame([(k * 7 % 50, "a") for k in range(200)] + [(None, "b")], "k int, v string").repartition(5)
    out = numbered(df, ["k"], "n").orderBy("n").collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [r.n for r in out] == list(range(201)) and [r.k for r in out] == [None] + sorted(k * 7 % 50 for k in range(200))
    assert numbered(df.limit(0), ["k"]).count() == 0
