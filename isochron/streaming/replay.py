"""Records as streams and streams as tables: a stored record comes again in small batches, out of order within a bound, and what a stream writes until its end is read back."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isochron.working import new_path

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextlib.contextmanager
def state_on_disk(spark: SparkSession) -> Iterator[None]:
    """Within it, streams keep their state in RocksDB, which ``transformWithState`` needs and which states larger than the memory need. The old setting comes back."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


def replayed(rows: DataFrame, ts: str, seed: int, spread_hours: int, batches: int, late_hours: int) -> DataFrame:
    """``rows`` as a stream of ``batches`` batches, with an instant ``ts``: a row comes up to ``spread_hours`` after its time, by hash of the row and ``seed``.

    A last batch has one row of nulls, but for a time ``late_hours`` and a day after the record: a heartbeat that moves the watermark past the record's end.
    A batch has as many files as a shuffle has tasks (fewer, of few rows); the source takes that many at once, in order of their making. So no row is later
    than a watermark of ``late_hours`` if that covers the spread and the length of a batch; less is refused. Rows without a time are left out: they have no place in a stream.
    """
    spark = rows.sparkSession
    timed = rows.where(F.col(ts).isNotNull()).withColumn(ts, F.col(ts).cast("timestamp"))
    lo, hi, first = timed.agg(F.min(ts), F.max(ts), F.min(F.unix_micros(F.col(ts)))).first()
    path = new_path(spark, "stream")
    if lo is None:
        timed.write.parquet(path)
        return spark.readStream.schema(timed.schema).parquet(path)
    arrives = F.unix_micros(F.col(ts)) + F.pmod(F.xxhash64(F.lit(seed), *timed.columns), F.lit(spread_hours * 3_600_000_000 + 1))
    span = int((hi - lo).total_seconds()) * 1_000_000 + spread_hours * 3_600_000_000 + 1_000_001
    if span / batches / 3.6e9 + spread_hours > late_hours:
        raise ValueError("late_hours must cover the spread and a batch")
    dealt = timed.withColumn("__batch", F.least(F.floor((arrives - F.lit(first)) * batches / F.lit(span)), F.lit(batches - 1)).cast("int"))
    held = new_path(spark, "arrivals")
    dealt.write.partitionBy("__batch").parquet(held)
    arrived = spark.read.schema(dealt.schema).parquet(held)
    files = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for k in range(batches):  # one after another, as the source goes by the files' times
        arrived.where(F.col("__batch") == k).drop("__batch").repartition(files).write.mode("append").parquet(path)
    at_once = max(1, len(spark.read.schema(timed.schema).parquet(path).inputFiles()) // batches)
    beat = [F.lit(None).cast(f.dataType).alias(f.name) if f.name != ts else F.timestamp_micros(F.lit(first + span + (late_hours + 24) * 3_600_000_000)).alias(ts) for f in timed.schema.fields]
    spark.range(1).select(beat).write.mode("append").parquet(path)
    return spark.readStream.schema(timed.schema).option("maxFilesPerTrigger", at_once).parquet(path)


def drained(stream: DataFrame, timeout: int = 3600) -> DataFrame:
    """What ``stream`` writes in append mode until its source's end, as a table in the shared folder.

    Progress and state are kept there, too, so a lost executor or driver goes on from the last batch. A failure of the stream is raised here.
    """
    spark = stream.sparkSession
    out, progress = new_path(spark, "streamed"), new_path(spark, "progress")
    with state_on_disk(spark):
        q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", progress).outputMode("append").trigger(availableNow=True).start()
        if not q.awaitTermination(timeout):
            q.stop()
            raise TimeoutError("the stream did not come to its end")
    return spark.read.schema(stream.schema).parquet(out)
