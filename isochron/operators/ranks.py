"""Global row numbers: one range sort, written once, and one running total over its tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from isochron.working import new_path


def numbered(rows: DataFrame, by: list[str | Column], row: str = "__row") -> DataFrame:
    """``rows`` with a column ``row``: numbers from 0 without gaps, in the order of ``by``, nulls first.

    The rows are range-sorted and written to the shared folder with their place in their task, so that every
    later use, and every retry, sees the same numbers. Rows that are equal in ``by`` are told apart by their place in the
    input, for the sort alone: they spread over tasks, and where they are equal altogether it makes no difference
    which one gets which of their numbers. The totals have a row for each task of the sort. An empty
    table stays empty.
    """
    keys = [F.col(c) if isinstance(c, str) else c for c in by]
    tied = rows.withColumn("__tie", F.monotonically_increasing_id())
    in_order = tied.orderBy(*(k.asc_nulls_first() for k in keys), "__tie").drop("__tie")
    path = new_path(rows.sparkSession, "numbered")
    in_order.withColumn("__at", F.monotonically_increasing_id()).write.parquet(path)
    # the number of the task is in the upper bits of __at, the place in it in the lower 33
    placed = rows.sparkSession.read.parquet(path).withColumn("__task", F.shiftright("__at", 33))
    counts = placed.groupBy("__task").agg(F.count("*").alias("__n"))
    first = counts.select("__task", (F.sum("__n").over(W.partitionBy(F.lit(0)).orderBy("__task")) - F.col("__n")).alias("__first"))
    out = placed.join(F.broadcast(first), "__task")  # a row for each task of the sort
    return out.withColumn(row, F.col("__first") + F.col("__at").bitwiseAND((1 << 33) - 1)).select(*rows.columns, row)
