"""Small helpers that the corpus operators share."""

from __future__ import annotations

import contextlib
import gc
import re
import tempfile
import time
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts: blank, tab, line feed, vertical tab, form feed, carriage return.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names, or else that of the Spark context.

    Where neither is set, as in tests, a session on this machine alone gets a temporary one; a cluster is refused, as its
    tasks would write to folders that no other machine reads.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        folder = tempfile.mkdtemp(prefix="checkpoints-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder, without its lineage. Reliable: a lost executor loses nothing."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """``df`` written as Parquet to the shared checkpoint folder and read again: ``cut`` for many rows, in less space.

    The files go when the session ends. The shuffles that made them are needed no more; Spark removes
    those once the JVM's collector has found them unused, which is asked for here.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    jvm = spark.sparkContext._jvm
    del df
    gc.collect()
    jvm.System.gc()
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.parquet(path)


def release_shuffles(spark: SparkSession) -> None:
    """Lets Spark remove the shuffles of frames that are used no more, before a step that needs the space.

    Python's references are given up by a thread that wakes once a second; only after that the JVM's collector finds what they held.
    """
    gc.collect()
    time.sleep(1.5)
    spark.sparkContext._jvm.System.gc()


def row_keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with __row (bigint): a number of each row, rising with doc_id, nulls first.

    It is doc_id itself if that is a whole number that no row lacks and no two share. Else the rows are
    sorted by id and written with a number of their own, so that every later use sees the same one.
    """
    whole = docs.schema["doc_id"].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")
    if whole and docs.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL").limit(1).count() == 0:
        return docs.withColumn("__row", F.col("doc_id").cast("bigint"))
    by_id = docs.orderBy(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    return stored(by_id.withColumn("__row", F.monotonically_increasing_id()))


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Within it, Arrow batches have at most ``rows`` rows: for jobs over whole texts that need memory besides. The old setting comes back."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def salt(*keys: str | Column, salts: int) -> Column:
    """A number below ``salts``, by hash of ``keys``: splits the rows of one hot group."""
    return F.pmod(F.xxhash64(F.lit("salt"), *keys), F.lit(salts)).cast("int")


def join_groups(rows: DataFrame, key: list[str], row_key: str, aggs: list[Column], totals: list[Column], salts: int = 64) -> DataFrame:
    """``rows`` with what ``totals`` make of each group of ``key``, without a hot group in one task.

    ``aggs`` are computed per (key, salt), ``totals`` per key from those. A group's result goes back
    only to the salts that it has, so that a group of any size is joined by up to ``salts`` tasks.
    Null keys are not expected.
    """
    salted = rows.withColumn("__salt", salt(row_key, salts=salts))
    partial = salted.groupBy(*key, "__salt").agg(*aggs)
    total = partial.groupBy(*key).agg(*totals, F.collect_set("__salt").alias("__salts"))
    spread = total.withColumn("__salt", F.explode("__salts")).drop("__salts")
    return salted.join(spread, [*key, "__salt"]).drop("__salt")


def spread_join(rows: DataFrame, other: DataFrame, key: list[str], by: list[str], salts: int = 64) -> DataFrame:
    """``rows`` joined with ``other``, which has each ``key`` at most once, without all rows of a hot key in one task.

    Rows are dealt out by ``key`` and a hash of ``by``; a row of ``other`` goes only to the salts that its rows have.
    """
    salted = rows.withColumn("__salt", salt(*by, salts=salts))
    present = salted.select(*key, "__salt").distinct().join(other, key)
    return salted.join(present, [*key, "__salt"]).drop("__salt")
