"""The most similar known text for each query, by the ratio of matching blocks, exact, without comparing all with all.

With M characters in matching blocks the ratio of texts of lengths a and b is 2 M / (a + b). The blocks make a common
subsequence, so the query becomes the known text by deleting a - M characters and inserting b - M. A deletion takes away at most
q of the query's q-grams, an insertion at most q - 1. So texts of a ratio of at least s share a number of q-grams (each
counted as often as it occurs) that s and the lengths tell. A first look at a few texts with the rarest common grams gives
each query its s; then only texts that share a gram of the query's rarest ones, enough of them for that number, can be better.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from isochron.working import cut

_KEPT = 1e-9  # of rounding


def _grams(texts: DataFrame, key: str, sizes: tuple[int, ...]) -> DataFrame:
    """key, q, gram: the q-grams of each text, the second of equal ones told from the first."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, q, gram = [], [], []
            for k, text in enumerate(batch.column(0).to_pylist()):
                for size in sizes:
                    for g, n in Counter(text[i : i + size] for i in range(len(text) - size + 1)).items():
                        at += [k] * n
                        q += [size] * n
                        gram += [f"{g}#{j}" for j in range(n)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(q, pa.int32()), pa.array(gram, pa.string())], [key, "q", "gram"])

    return texts.select(key).mapInArrow(split, f"`{key}` string, q int, gram string")


def _scored(pairs: DataFrame) -> DataFrame:
    """a, b, least to a, b, ratio; pairs whose bounds say that the ratio is below ``least`` are left out."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, ratios = [], []
            for k, (a, b, least) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True)):
                m = SequenceMatcher(a=a, b=b)
                if m.real_quick_ratio() + _KEPT >= least and m.quick_ratio() + _KEPT >= least:
                    kept.append(k)
                    ratios.append(m.ratio())
            rows = batch.take(pa.array(kept, pa.int64()))
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(ratios, pa.float64())], ["a", "b", "ratio"])

    return pairs.select("a", "b", "least").mapInArrow(score, "a string, b string, ratio double")


def _shared(q: Column, n: Column, least: Column, other: Column) -> Column:
    """q-grams that a query of ``n`` characters shares at least with a text of ``other`` characters and a ratio of ``least``."""
    blocks = least * (n + other) / 2
    return n - q + 1 - q * (n - blocks) - (q - 1) * (other - blocks)


def nearest_matches(queries: DataFrame, known: DataFrame, key: str = "key", looks: int = 8, sizes: tuple[int, ...] = (1, 2, 3, 4)) -> DataFrame:
    """key, best, ratio: of each distinct query the known text with the highest ratio (the first in code point order of equal ones), other than itself.

    best is null and the ratio 0 where no other known text shares a character. Null texts are left out on both sides. ``looks``: rare grams of a query that
    the first look follows, to two texts each; it changes the work, not the result. The work
    grows with how much unlike texts have in common: where all share a template, or a query has nothing like it, its rarest grams have many texts behind them, which are then
    compared in tasks of their own, none left out.
    """
    asked = cut(queries.where(F.col(key).isNotNull()).select(F.col(key).alias("a")).distinct())
    other = cut(known.where(F.col(key).isNotNull()).select(F.col(key).alias("b")).distinct())
    index = cut(_grams(other, "b", sizes))
    counts = index.groupBy("q", "gram").agg(F.count("*").alias("n"), F.min("b").alias("lo"), F.max("b").alias("hi"))
    rarest = W.partitionBy("a", "q").orderBy("n", "gram")
    mine = _grams(asked, "a", sizes).join(counts, ["q", "gram"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    mine = cut(mine.withColumn("rank", F.row_number().over(rarest)).withColumn("grams", F.count("*").over(W.partitionBy("a", "q"))))

    found = W.partitionBy("a", "q").orderBy("n", "gram")
    first = mine.where(f"n > 0 AND q = {max(sizes)} OR n > 0 AND q = {min(sizes)}").withColumn("look", F.row_number().over(found)).where(F.col("look") <= looks)
    first = first.select("a", F.explode(F.array("lo", "hi")).alias("b")).distinct().where("a <> b").withColumn("least", F.lit(0.0))
    start = _scored(first).groupBy("a").agg(F.max("ratio").alias("least"))
    start = cut(asked.join(start, "a", "left").select("a", F.coalesce("least", F.lit(0.0)).alias("least"), F.char_length("a").alias("chars")))

    # of the sizes of grams the one whose prefix has the fewest known texts behind it; for single characters there always is a prefix
    lower, upper = F.ceil(F.col("chars") * F.col("least") / (2 - F.col("least")) - _KEPT), F.floor(F.col("chars") * (2 - F.col("least")) / F.col("least") + _KEPT)
    bound = start.withColumn("lower", lower).withColumn("upper", F.when(F.col("least") > 0, upper).otherwise(F.lit(1 << 40)))
    grams = mine.join(bound, "a")
    tau = F.least(_shared(F.col("q"), F.col("chars"), F.col("least"), F.col("lower")), _shared(F.col("q"), F.col("chars"), F.col("least"), F.col("upper")))
    grams = grams.withColumn("tau", F.greatest(F.ceil(tau - _KEPT), F.when(F.col("q") == 1, F.lit(1)).otherwise(F.lit(0)))).where("tau >= 1")
    prefix = grams.where("rank <= grams - tau + 1")
    cost = prefix.groupBy("a", "q").agg(F.sum("n").alias("behind"))
    chosen = cost.groupBy("a").agg(F.min_by("q", F.struct("behind", F.lit(0) - F.col("q"))).alias("q"))
    probes = prefix.join(chosen, ["a", "q"]).select("a", "q", "gram", "least", "lower", "upper")
    met = probes.join(index, ["q", "gram"]).where("a <> b AND char_length(b) BETWEEN lower AND upper").select("a", "b", "least").distinct()
    best = _scored(met).where("ratio > 0").groupBy("a").agg(F.min_by("b", F.struct(F.lit(0) - F.col("ratio"), F.col("b"))).alias("best"), F.max("ratio").alias("ratio"))
    return asked.join(best, "a", "left").select(F.col("a").alias(key), "best", F.coalesce("ratio", F.lit(0.0)).alias("ratio"))
