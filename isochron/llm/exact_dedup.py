"""Exact dedup by two-pass Bloom filtering.

Pass 1 reduces every text to a SHA-256 and sends 8 bytes of it (unique within a batch) to a segment
of the filter. Each segment keeps one Bloom filter of the hashes that it has seen and enters those it
meets again in a second one. Pass 2 probes the second filter: a row whose hash is not in it has no
equal and passes straight through, the others shuffle and are grouped by the whole SHA-256. A false
positive costs a shuffled row, never a wrong result.

The second filter is broadcast. Its size is 16 bits a row, at most ``max_filter_bits`` (32 MB at the
default); beyond that the segments fill up, more rows shuffle, and the result stays exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isochron.llm.common import SPACE, cut, join_groups

SEGMENT_BITS = 1 << 18
PROBES = 4


def normalised(text: Column) -> Column:
    """``text`` with each run of white space as one blank; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def _positions(hashes: np.ndarray) -> Iterator[np.ndarray]:
    """``PROBES`` bit positions of each hash in its segment, by double hashing."""
    h = hashes.view(np.uint64)
    low, step = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    for i in range(PROBES):
        yield ((low + np.uint64(i) * step) % np.uint64(SEGMENT_BITS)).astype(np.int64)


def _segment(hashes: np.ndarray, segments: int) -> np.ndarray:
    mixed = hashes.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed >> np.uint64(32)) % np.uint64(segments)).astype(np.int32)


def repeat_filter(hashes: DataFrame, rows: int, max_filter_bits: int = 1 << 28) -> np.ndarray:
    """Bits of the hashes that occur more than once; ``hashes`` has one bigint column.

    Shape (segments, SEGMENT_BITS / 8). A task holds the two filters of one segment and a batch.
    """
    segments = max(1, min(max_filter_bits // SEGMENT_BITS, -(-16 * rows // SEGMENT_BITS)))

    def unique(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h, n = np.unique(b.column(0).to_numpy(zero_copy_only=False), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(_segment(h, segments)), pa.array(h), pa.array(n > 1)], ["segment", "h", "again"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, once, twice = None, None, None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([np.packbits(twice).tobytes()], pa.binary())], ["segment", "bits"])

        for b in batches:
            seg, h, again = (c.to_numpy(zero_copy_only=False) for c in b.columns)
            cuts = np.flatnonzero(np.diff(seg)) + 1
            for part, many in zip(np.split(np.arange(len(seg)), cuts), np.split(again, cuts), strict=True):
                if not len(part):
                    continue
                if seg[part[0]] != now:
                    if now is not None:
                        yield done()
                    now, once, twice = int(seg[part[0]]), np.zeros(SEGMENT_BITS, bool), np.zeros(SEGMENT_BITS, bool)
                own, n = np.unique(h[part], return_counts=True)
                own_again = np.isin(own, h[part][many]) | (n > 1)
                own_again |= np.logical_and.reduce([once[p] for p in _positions(own)])
                for p in _positions(own):
                    once[p] = True
                for p in _positions(own[own_again]):
                    twice[p] = True
        if now is not None:
            yield done()

    parts = hashes.mapInArrow(unique, "segment int, h bigint, again boolean").repartition("segment").sortWithinPartitions("segment")
    bits = np.zeros((segments, SEGMENT_BITS // 8), np.uint8)
    for r in parts.mapInArrow(build, "segment int, bits binary").collect():  # at most max_filter_bits / 8 bytes
        bits[r.segment] |= np.frombuffer(r.bits, np.uint8)
    return bits


def exact_dedup(docs: DataFrame, max_filter_bits: int = 1 << 28) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256, shuffled.

    Texts are equal when identical after each run of white space became one blank; of equal texts the
    row with the smallest doc_id stays. Null texts count as empty. Null ids come after all others; of
    rows that repeat an id one stays. Columns other than doc_id and text are ignored, so their names
    cannot clash. An empty table gives an empty result. ``shuffled`` tells the rows that the filter
    did not clear.
    """
    spark = docs.sparkSession
    ids = docs.select("doc_id", F.sha2(normalised(F.col("text")), 256).alias("text_sha256"))
    hashed = ids.withColumn("__h", F.conv(F.substring("text_sha256", 2, 15), 16, 10).cast("bigint"))
    bits = repeat_filter(hashed.select("__h"), docs.count(), max_filter_bits)
    shared, segments = spark.sparkContext.broadcast(bits), bits.shape[0]

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for b in batches:
            h = b.column("__h").to_numpy(zero_copy_only=False)
            seg = _segment(h, segments)
            maybe = np.ones(len(h), bool)
            for p in _positions(h):
                maybe &= (bits[seg, p >> 3] >> (7 - (p & 7)).astype(np.uint8) & 1).astype(bool)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_sha256"), pa.array(maybe)], ["doc_id", "text_sha256", "shuffled"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    probed = hashed.mapInArrow(probe, f"doc_id {kind}, text_sha256 string, shuffled boolean")
    probed = cut(probed.withColumn("__row", F.monotonically_increasing_id()))
    alone = probed.where(~F.col("shuffled")).select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"), F.lit(True).alias("kept"), "text_sha256", "shuffled"
    )
    order = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"), F.col("__row").alias("r"))
    grouped = join_groups(
        probed.where("shuffled"), ["text_sha256"], "__row",
        [F.min(order).alias("__first"), F.count("*").alias("__n")],
        [F.min("__first").alias("__first"), F.sum("__n").alias("group_size")],
    )
    return alone.unionByName(
        grouped.select("doc_id", F.col("__first.d").alias("keep_id"), "group_size", (F.col("__row") == F.col("__first.r")).alias("kept"), "text_sha256", "shuffled")
    )


def drop_exact_duplicates(docs: DataFrame, max_filter_bits: int = 1 << 28) -> DataFrame:
    """The rows of ``docs`` whose doc_id stays in ``exact_dedup``; all columns stay. Ids must be unique and not null."""
    kept = exact_dedup(docs, max_filter_bits).where("kept").select("doc_id")
    return docs.join(kept, "doc_id", "left_semi")
