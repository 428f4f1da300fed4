"""Document fingerprints: a homomorphic hash of the multiset of paragraphs.

A paragraph (a line) has a wide vector: LANES numbers modulo 2^64 hashed from the whole paragraph, and
a sketch of SKETCH numbers modulo 2^24 that counts its windows of 8 code points with random signs. A
document's fingerprint is the sum of its paragraphs' vectors, modulo those powers: the order of
paragraphs doesn't count, and inserting or deleting a paragraph adds or subtracts its vector. The
first part decides equality; of the second, inner products estimate how much two documents share.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LANES, SKETCH, SKETCH_BITS, WINDOW = 16, 256, 24, 8
_R = [pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in (1, 2, 4)]
FIRST = -(1 << 63)  # stands for a null id in orderings: before all others


def vector(text: str) -> np.ndarray:
    """The sum of the vectors of the paragraphs of ``text``: LANES + SKETCH numbers of uint64."""
    hashed = b"".join(hashlib.shake_128(p.encode()).digest(8 * LANES) for p in text.split("\n"))
    out = np.zeros(LANES + SKETCH, np.uint64)
    out[:LANES] = np.frombuffer(hashed, "<u8").reshape(-1, LANES).sum(axis=0, dtype=np.uint64)
    if len(text) >= WINDOW:
        h = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.uint64)
        crosses = h == 10
        for k, r in enumerate(_R):  # windows of 2, 4, 8 code points
            step = 1 << k
            h = h[:-step] * np.uint64(r) + h[step:]
            crosses = crosses[:-step] | crosses[step:]
        h = h[~crosses]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        signed = np.bincount((h >> np.uint64(55)).astype(np.int64), minlength=2 * SKETCH).reshape(SKETCH, 2)
        out[LANES:] = (signed[:, 0] - signed[:, 1]).astype(np.int64).view(np.uint64)
    return out


def insert(fingerprint: np.ndarray, paragraphs: str) -> np.ndarray:
    """The vector after paragraphs were added (in any place)."""
    return fingerprint + vector(paragraphs)


def delete(fingerprint: np.ndarray, paragraphs: str) -> np.ndarray:
    """The vector after paragraphs were taken away."""
    return fingerprint - vector(paragraphs)


def encode(fingerprint: np.ndarray) -> str:
    """Base64 of the numbers, the sketch's modulo 2^24."""
    sketch = np.ascontiguousarray(fingerprint[LANES:]).astype("<u8").view(np.uint8).reshape(SKETCH, 8)[:, : SKETCH_BITS // 8]
    return base64.b64encode(fingerprint[:LANES].astype("<u8").tobytes() + np.ascontiguousarray(sketch).tobytes()).decode()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of text in common, by the sketches: 0 to 1, and 1 if the fingerprints are equal."""
    if np.array_equal(a[:LANES], b[:LANES]):
        return 1.0
    x, y = (v[LANES:].view(np.int64).astype(np.float64) for v in (a, b))
    both = x @ x + y @ y
    return float(min(1.0, max(0.0, 2 * (x @ y) / both))) if both else 0.0


def document_fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of each row of ``docs`` (doc_id, text); null counts as empty. Other columns are ignored."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([encode(vector(t or "")) for t in b.column(1).to_pylist()], pa.string())], ["doc_id", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(each, f"doc_id {kind}, fingerprint string")


def with_following(docs: DataFrame, rows_per_chunk: int = 1000) -> DataFrame:
    """Rows of ``docs`` (doc_id, text) in chunks, each row's next by descending id in the same chunk.

    Columns: chunk, extra, key, doc_id, text; sorted so within partitions. Chunks are ranges of ids,
    cut at ids that occur (approximate quantiles, a bounded array). The rows at a chunk's upper end are
    copied to the next chunk up as its last rows (``extra``), those of the largest id to the lowest
    chunk. Equal ids are ordered by text; null ids follow the smallest.
    """
    spark = docs.sparkSession
    keyed = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("bigint"), F.lit(FIRST)).alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    n = keyed.count()
    chunks = max(1, min(-(-n // rows_per_chunk), 16 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    found, largest = keyed.agg(F.percentile_approx("key", [(k + 1) / chunks for k in range(chunks)], 100_000), F.max("key")).first()
    cuts = np.array(sorted({*(found or []), FIRST if largest is None else largest}), np.int64)

    def places(keys: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for k in keys:
            own = np.searchsorted(cuts, k.to_numpy())
            at_cut = cuts[own] == k.to_numpy()
            yield pd.Series([[p, (p + 1) % len(cuts)] if c else [p] for p, c in zip(own.tolist(), at_cut.tolist(), strict=True)])

    placed = keyed.withColumn("places", F.pandas_udf(places, "array<int>")("key"))
    spread = placed.select("doc_id", "key", "text", F.posexplode("places").alias("extra", "chunk"))
    return spread.select("chunk", "extra", "key", "doc_id", "text").repartition("chunk").sortWithinPartitions("chunk", "extra", F.desc("key"), "text")


def compared_with_next(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text, of its edited text, and how alike they are.

    The edited text has the last floor(n_chars / 3) code points replaced by the first as many (or all)
    of the next document's, by descending id; the last document is followed by the first. One row
    per row of ``docs``: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next. A sole document follows itself. The edited fingerprint is made from the text's by
    deleting the paragraphs from the cut on and inserting the new ones.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(doc, text, own, following, of_next):
            cut = len(text) - len(text) // 3
            edited, line = text[:cut] + following[: len(text) // 3], text.rfind("\n", 0, cut) + 1
            changed = insert(delete(own, text[line:]), edited[line:])
            return doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), encode(own), encode(changed), likeness(own, changed), likeness(own, of_next)

        before = None
        for b in batches:
            rows = []
            for chunk, extra, _, doc, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                own = vector(text)
                if before is not None and before[0] == chunk and not before[1]:
                    rows.append(row(*before[2:], text, own))
                before = (chunk, extra, doc, text, own)
            yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow, names = to_arrow_schema(StructType.fromDDL(schema)), [f.split()[0] for f in schema.split(", ")]
    return with_following(docs).mapInArrow(compare, schema)
