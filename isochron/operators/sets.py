"""Result sets and multisets: equality, overlap, tolerant comparison, overlaps of parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isochron.operators.joins import positional_join


def set_equal(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row, equal: the same rows, whatever their order and number. Columns count by position."""
    b = b.toDF(*a.columns)
    sides = a.select(F.struct(*a.columns).alias("r"), F.lit(1).alias("s")).unionByName(b.select(F.struct(*b.columns).alias("r"), F.lit(2).alias("s")))
    one_sided = sides.groupBy("r").agg(F.count_distinct("s").alias("n")).where("n < 2")
    return one_sided.agg((F.count("*") == 0).alias("equal"))


def row_f1(gold: DataFrame, test: DataFrame) -> DataFrame:
    """precision, recall, f1 of distinct rows in common; two empty sets give 1."""
    test = test.toDF(*gold.columns)
    sides = gold.select(F.struct(*gold.columns).alias("r"), F.lit(1).alias("g"), F.lit(0).alias("t")).unionByName(test.select(F.struct(*test.columns).alias("r"), F.lit(0).alias("g"), F.lit(1).alias("t")))
    per = sides.groupBy("r").agg(F.max("g").alias("g"), F.max("t").alias("t"))
    n = per.agg(F.coalesce(F.sum("g"), F.lit(0)).alias("g"), F.coalesce(F.sum("t"), F.lit(0)).alias("t"), F.coalesce(F.sum(F.col("g") * F.col("t")), F.lit(0)).alias("both"))
    empty = (F.col("g") == 0) & (F.col("t") == 0)
    share = lambda x: F.when(empty, 1.0).otherwise(F.coalesce(F.try_divide("both", x), F.lit(0.0)))
    return n.select(share("t").alias("precision"), share("g").alias("recall"), F.when(empty, 1.0).otherwise(F.coalesce(F.try_divide(2 * F.col("both"), F.col("g") + F.col("t")), F.lit(0.0))).alias("f1"))


def close(a: Column, b: Column, absolute: float = 1e-9, relative: float = 1e-6) -> Column:
    """Equal within tolerances; nulls are equal to nulls only."""
    return F.coalesce(F.abs(a - b) <= absolute + relative * F.abs(b), a.isNull() & b.isNull())


def tolerant_equal(a: DataFrame, b: DataFrame) -> DataFrame:
    """rows, mismatches of two numeric tables, sorted by all columns and compared by position."""
    b = b.toDF(*(f"__{c}" for c in a.columns))
    both = positional_join(a, b, a.columns, b.columns)
    same = F.lit(True)
    for c in a.columns:
        same = same & close(F.col(c), F.col(f"__{c}"))
    return both.agg(F.count("*").alias("rows"), F.count_if(~same).alias("mismatches"))


def same_members(a: Column, b: Column) -> Column:
    """Arrays with the same distinct members."""
    return F.sort_array(F.array_distinct(a)) == F.sort_array(F.array_distinct(b))


def multiset_overlap(a: DataFrame, b: DataFrame, keys: list[str], item: str) -> DataFrame:
    """Per keys: matched (sum of the smaller counts), extra in ``a``, missing from ``a``."""
    x = a.groupBy(*keys, item).agg(F.count("*").alias("x"))
    y = b.groupBy(*keys, item).agg(F.count("*").alias("y"))
    both = x.join(y, [*keys, item], "full_outer").fillna(0, ["x", "y"])
    return both.groupBy(*keys).agg(F.sum(F.least("x", "y")).alias("matched"), F.sum(F.greatest(F.col("x") - F.col("y"), F.lit(0))).alias("extra"), F.sum(F.greatest(F.col("y") - F.col("x"), F.lit(0))).alias("missing"))


def value_overlaps(params: DataFrame, split: str = "split") -> DataFrame:
    """Values of a parameter that occur in several splits: template_id, param, value, splits. ``params``: split, template_id, params map."""
    long = params.select(split, "template_id", F.explode("params").alias("param", "value"))
    return long.groupBy("template_id", "param", "value").agg(F.count_distinct(split).alias("splits")).where("splits > 1")
