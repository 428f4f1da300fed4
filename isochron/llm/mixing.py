"""Mixing sources to target weights by a low-discrepancy schedule.

A source's documents, shuffled by a hash of their id, form one stream of words that repeats; the
stream is cut into blocks of ``block`` words. Slots of the schedule take van der Corput points and map
them through the cumulative weights (blocks to take) to a source; the k-th slot of a source takes its
k-th block, and only what a slot takes is in the mix. In any stretch of the schedule each source has
its share of the slots, but for about a block. All steps are DataFrame expressions. Ranks and running
totals are computed in two levels, each of about the square root of all rows, so that no task holds a
whole source.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from isochron.llm.common import WORD, cut, partitions, row_keyed

#: Weights by rank of the source, repeating.
WEIGHTS = (3, 1, 2)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Words to take per source: source, source_size, target. ``sizes`` has source, size.

    Sources in code point order, null last, take ``weights`` in turn and share ``share`` times all
    words; a target stops at ``most`` times its source's size and the excess is shared again by
    weight. That ends at min(most * size, level * weight) with one level for all, which is found by
    running totals over the sources in order of size / weight: one row a source is sorted, no more.
    """
    per = sizes.groupBy("source").agg(F.sum("size").cast("bigint").alias("source_size"))
    by_name = W.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int")).cast("double"))
    per = per.withColumn("cap", F.col("source_size") * F.lit(most))
    # caps are reached in order of cap / weight; before row k, all earlier ones are at their caps
    filling = W.partitionBy(F.lit(0)).orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    everything = W.partitionBy(F.lit(0))
    per = per.withColumn("before", F.coalesce(F.sum("cap").over(filling.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
    per = per.withColumn("rest_w", F.sum("w").over(filling.rowsBetween(W.currentRow, W.unboundedFollowing)))
    per = per.withColumn("total", F.sum("source_size").over(everything) * F.lit(share))
    per = per.withColumn("level", (F.col("total") - F.col("before")) / F.col("rest_w"))
    per = per.withColumn("level", F.min(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct(F.col("before"), F.col("level")))).over(everything)["level"])
    return per.select("source", "source_size", F.coalesce(F.least("cap", F.col("level") * F.col("w")), F.col("cap")).alias("target"))


def _named(df: DataFrame) -> DataFrame:
    """``df`` with null_source and has, which stand for the source in joins."""
    return df.withColumn("has", F.coalesce("source", F.lit(""))).withColumn("null_source", F.col("source").isNull())


def slot_bits(blocks: int) -> int:
    """k: a schedule of ``blocks`` blocks has slots 0 to 2 ** k - 1, of which so many are filled."""
    return max(0, blocks - 1).bit_length()


def schedule(needs: DataFrame, blocks: int, bins: int = 4096) -> DataFrame:
    """Slots: slot, source, rank (of the slot among its source's, from 0).

    ``needs``: source, need (blocks to take); ``blocks``: their sum. Of 2 ** k cells, as many as slots, each
    source has ``need`` after those of the sources before it. Slot i takes the van der Corput point of i (its k
    bits reversed); the source in whose cells the point lies gets the slot. Among 2 ** k points each cell
    has one, so that each source gets exactly the slots it needs; slots whose point lies beyond the last source stay empty. Points find
    their source by an equi-join on the bin in which both lie. Ranks: slots are counted per
    (source, chunk), running totals over the chunks give each chunk's first rank.
    """
    k = slot_bits(blocks)
    chunk, width = 1 << -(-k // 2), max(0, k - (bins - 1).bit_length())
    point = F.conv(F.reverse(F.lpad(F.bin("id"), k, "0")), 2, 10).cast("bigint") if k else F.lit(0).cast("bigint")
    points = needs.sparkSession.range(1 << k).select(F.col("id").alias("slot"), point.alias("cell")).where(F.col("cell") < blocks)
    points = points.withColumn("bin", F.shiftright("cell", width))
    order = W.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())  # a row for each source
    shares = needs.where("need > 0").withColumn("hi", F.sum("need").over(order)).withColumn("lo", F.col("hi") - F.col("need"))
    per_bin = shares.withColumn("bin", F.explode(F.sequence(F.shiftright("lo", width), F.shiftright(F.col("hi") - 1, width))))
    drawn = points.join(per_bin.select("bin", "source", "lo", "hi"), "bin").where("cell >= lo AND cell < hi")
    drawn = _named(drawn.select("slot", "source", F.floor(F.col("slot") / chunk).alias("chunk")))
    key = ["null_source", "has"]
    counts = drawn.groupBy(*key, "chunk").agg(F.count("*").alias("n"))
    before = counts.withColumn("first", F.sum("n").over(W.partitionBy(*key).orderBy("chunk")) - F.col("n")).drop("n")
    ranked = drawn.withColumn("in_chunk", F.row_number().over(W.partitionBy(*key, "chunk").orderBy("slot")) - 1)
    return ranked.join(before, [*key, "chunk"]).select("slot", "source", (F.col("first") + F.col("in_chunk")).alias("rank"))


def _blocks(sized: DataFrame, targets: DataFrame, need: int, block: int) -> DataFrame:
    """Pieces of documents in the mix: each lies in a block that a slot takes.

    ``sized``: doc_id, source, size (all above 0), or more columns, which break ties; ``targets``: source, source_size, target, goal, need; ``need``: all blocks. Columns: those, start (place in
    the source's stream), epoch (pass over it), words (of the piece), slot.
    """
    key = ["null_source", "has"]
    info = _named(targets).select(*key, "source_size", "target", "goal")

    # a document's place in its source's stream: running totals over buckets of the hash, then within
    words = _named(sized).withColumn("by", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    buckets = math.isqrt(sized.count()) + 1
    words = words.withColumn("bucket", F.floor(F.conv(F.substring("by", 1, 8), 16, 10).cast("bigint") * buckets / F.lit(1 << 32)))
    sums = words.groupBy(*key, "bucket").agg(F.sum("size").alias("in_bucket"))
    sums = sums.withColumn("first", F.sum("in_bucket").over(W.partitionBy(*key).orderBy("bucket")) - F.col("in_bucket")).drop("in_bucket")
    inner = W.partitionBy(*key, "bucket").orderBy("by", "doc_id", "size", *(c for c in sized.columns if c not in ("doc_id", "source", "size"))).rowsBetween(W.unboundedPreceding, 0)
    placed = words.withColumn("start", F.sum("size").over(inner) - F.col("size")).join(sums, [*key, "bucket"]).join(info, key)
    placed = placed.withColumn("start", F.col("start") + F.col("first"))

    # the pieces of each pass over the stream, cut at block borders
    epochs = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.col("goal") - 1 - F.col("start")) / F.col("source_size")).cast("int")))
    passes = placed.withColumn("epoch", F.explode(epochs)).withColumn("at", F.col("start") + F.col("epoch") * F.col("source_size"))
    passes = passes.withColumn("until", F.least(F.col("at") + F.col("size"), "goal")).where("until > at")
    pieces = passes.withColumn("rank", F.explode(F.sequence(F.floor(F.col("at") / block), F.floor((F.col("until") - 1) / block))))
    pieces = pieces.withColumn("words", F.least("until", (F.col("rank") + 1) * block) - F.greatest("at", F.col("rank") * block))
    slots = _named(schedule(targets.select("source", "need"), need)).select(*key, "rank", "slot")
    return pieces.join(slots, [*key, "rank"]).select(*sized.columns, "source_size", "target", "start", "epoch", "words", "slot")


def _sized(docs: DataFrame, block: int) -> tuple[DataFrame, DataFrame, int]:
    """doc_id, source, size and __row of each row; targets of the sources, with goal (whole words) and need (blocks); all blocks needed."""
    sized = cut(docs.select("doc_id", "source", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("bigint").alias("size"), "__row"))
    targets = source_targets(sized).withColumn("goal", F.round("target").cast("bigint"))
    targets = cut(targets.withColumn("need", F.ceil(F.col("goal") / block)))
    return sized, targets, targets.agg(F.coalesce(F.sum("need"), F.lit(0))).first()[0]


def mix(docs: DataFrame, block: int = 256) -> DataFrame:
    """Words of each document in the mix: doc_id, size, source_size, target, taken, first_slot, n_slots.

    ``docs`` has doc_id, source, text; other columns are ignored. size: number of words of the text
    (null: 0). n_slots of the schedule take ``taken`` words of the document (those of a slot that comes to it twice
    count twice), the first one being first_slot (null if none does, as with documents without words). The shuffle orders a source's documents by the MD5
    of the id (ties by id, then size; a null id counts as the empty string), which reruns and other
    engines repeat. Rows that repeat an id each have their own place. An empty table gives an empty result.
    """
    sized, targets, need = _sized(docs.select("doc_id", "source", "text", F.monotonically_increasing_id().alias("__row")), block)
    per = targets.select(F.col("source").alias("s"), "source_size", "target")
    out = ["doc_id", "size", "source_size", "target", "taken", "first_slot", "n_slots"]
    none = sized.join(per, F.col("source").eqNullSafe(F.col("s")))
    none = none.select("*", F.lit(0).cast("bigint").alias("taken"), F.lit(None).cast("bigint").alias("first_slot"), F.lit(0).cast("bigint").alias("n_slots"))
    if not need:
        return none.select(out)
    blocks = _blocks(sized.where("size > 0"), targets, need, block)
    taken = blocks.groupBy("__row").agg(F.sum("words").alias("taken"), F.min("slot").alias("first_slot"), F.count("*").alias("n_slots"))
    some = none.drop("taken", "first_slot", "n_slots").join(taken, "__row", "left")
    return some.withColumn("taken", F.coalesce("taken", F.lit(0))).withColumn("n_slots", F.coalesce("n_slots", F.lit(0))).select(out)


def mixed_documents(docs: DataFrame, block: int = 256) -> DataFrame:
    """The mix itself: rows of ``docs`` once for each pass that takes words of them, in order of the first slot that does, all columns kept.

    A pass that takes a part of a document takes its first words, joined by single blanks; whole
    texts stay as they are. A column n_chars is made anew. Rows with a null or repeated id each have their own place and
    passes. Without words in any text the mix is empty.
    """
    keyed = row_keyed(docs)
    sized, targets, need = _sized(keyed, block)
    if not need:
        return docs.limit(0)
    blocks = _blocks(sized.where("size > 0"), targets, need, block)
    passes = blocks.groupBy("__row", F.col("size").alias("__size"), F.col("epoch").alias("__epoch")).agg(F.sum("words").alias("__words"), F.min("slot").alias("__slot"))
    joined = keyed.join(passes, "__row")
    part = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1)), 1, F.col("__words").cast("int")), " ")
    out = joined.withColumn("text", F.when(F.col("__words") < F.col("__size"), part).otherwise(F.col("text")))
    # points are spread evenly, so equal ranges of slots go to tasks without a sample
    n, slots = partitions(docs.sparkSession), 1 << slot_bits(need)
    out = out.repartitionById(n, F.floor(F.col("__slot") * n / F.lit(slots)).cast("int")).sortWithinPartitions("__slot", "__row").select(docs.columns)
    return out.withColumn("n_chars", F.char_length("text").cast("bigint")) if "n_chars" in docs.columns else out
