"""Shards by a keyed permutation of the global row numbers.

Rows are numbered by id. A Feistel network over pairs (l, r), l below a and r below b, where a and b are the
two nearest factors whose product reaches the number of rows, permutes the numbers below a * b; a number that leaves
the range of the rows is permuted again until it is back (cycle walking). Position p of the shuffle
is slot p // shards of shard p % shards. So the shard and slot of a row number follow from the number of
rows and the seed alone, and the inverse tells which row stands at a slot: nothing is looked up, no
random numbers are sorted. All steps are column expressions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isochron.operators.ranks import numbered

ROUNDS = 4


def _halves(n: int) -> tuple[int, int]:
    a = math.isqrt(max(n, 1) - 1) + 1
    return a, -(-max(n, 1) // a)


def _mixed(seed: int, k: int, half: Column, below: int) -> Column:
    """Round function: the first 60 bits of an MD5 of seed, round and half, modulo ``below``."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:{k}:"), half.cast("string"))), 1, 15), 16, 10).cast("bigint") % F.lit(below)


def _once(x: Column, n: int, seed: int, back: bool) -> Column:
    """One pass of the network over a number below a * b, or its inverse."""
    a, b = _halves(n)
    right = x % F.lit(b)
    left = ((x - right) / F.lit(b)).cast("bigint")
    for k in range(ROUNDS)[:: -1 if back else 1]:
        sign = -1 if back else 1
        if k % 2 == 0:
            left = F.pmod(left + F.lit(sign) * _mixed(seed, k, right, a), F.lit(a))
        else:
            right = F.pmod(right + F.lit(sign) * _mixed(seed, k, left, b), F.lit(b))
    return left * F.lit(b) + right


def _walked(x: Column, n: int, seed: int, back: bool) -> Column:
    a, b = _halves(n)
    step = lambda y, _: F.when(y < n, y).otherwise(_once(y, n, seed, back))
    y = _once(x, n, seed, back)
    if beyond := a * b - n:
        # A walk meets each number beyond n at most once, so that many steps end any walk. A pass leaves the range with a chance of
        # about 1 / sqrt(n): hardly a row takes the first steps, and none in practice the last ones.
        walk = lambda z, steps: F.when(z < n, z).otherwise(F.aggregate(F.sequence(F.lit(1), F.lit(steps)), z, step))
        y = walk(y, min(beyond, 8))
        if beyond > 8:
            y = walk(y, beyond - 8)
    return y


def permuted(number: Column, n: int, seed: int = 1) -> Column:
    """The place in the shuffle of a row number below ``n`` (under 2 ** 52): a bijection of 0 to n - 1. Null stays null."""
    return _walked(number, n, seed, False)


def unpermuted(place: Column, n: int, seed: int = 1) -> Column:
    """The row number at a place of the shuffle: the inverse of ``permuted``."""
    return _walked(place, n, seed, True)


def sharded(rows: DataFrame, by: list[str | Column], shards: int = 8, seed: int = 1) -> DataFrame:
    """``rows`` with shard (int, 0 to shards - 1) and slot (bigint, from 0 without gaps in each shard).

    Rows are numbered in the order of ``by`` (nulls first), so the result is the same for any layout of the input and any
    number of tasks, if ``by`` tells different rows apart. Counts of the shards are at most one apart. Repeated
    rows each have their own slot; where ``by`` is equal, their numbers go to them in any order. Columns pass
    through, except that shard and slot are made anew. With fewer rows than shards some shards are
    empty; an empty table gives no rows.
    """
    kept = numbered(rows.drop("shard", "slot"), by)
    n = kept.count()
    at = kept.withColumn("__place", permuted(F.col("__row"), n, seed))
    return at.withColumn("shard", (F.col("__place") % shards).cast("int")).withColumn("slot", F.expr(f"__place DIV {int(shards)}")).drop("__row", "__place")


def write_shards(docs: DataFrame, path: str, shards: int = 8, seed: int = 1, rows_per_file: int = 1_000_000) -> None:
    """Writes ``docs`` (doc_id, text, any other columns) as Parquet, a folder for each shard, each file a stretch of slots in order.

    A shard of any size is written by as many tasks as it has stretches. Order: by doc_id, then by hash of the text.
    """
    out = sharded(docs, ["doc_id", F.xxhash64("text")], shards, seed).withColumn("__stretch", F.expr(f"slot DIV {int(rows_per_file)}"))
    dealt = out.repartition("shard", "__stretch").sortWithinPartitions("shard", "slot").drop("__stretch")
    dealt.write.partitionBy("shard").option("maxRecordsPerFile", rows_per_file).parquet(path)


def shard_report(docs: DataFrame, shards: int = 8, seed: int = 1) -> DataFrame:
    """Per document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    size: bytes of the text in UTF-8 (null: none) plus 1; text_crc32: CRC-32 of the text (null counts as empty). The law is ``rows``:
    counts of the shards are at most one apart; so grown_shard is null. ``docs`` has doc_id and text,
    other columns are ignored; rows that repeat an id or have none are documents of their own.
    """
    text = F.coalesce("text", F.lit("")).cast("binary")
    small = docs.select("doc_id", (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"))
    out = sharded(small, ["doc_id", "size", "text_crc32"], shards, seed)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
