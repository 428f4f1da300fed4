"""Near-dedup by an exact set-similarity join on shingles of words.

A text is the set of its shingles, as 64-bit hashes. Two texts are linked if the Jaccard similarity of
their sets is at least ``least``. Shingles are ordered by rarity (rank of one of 65,536 buckets, then
hash); of each distinct set the rarest ones, as many as two linked sets must have one of in common,
are its prefix. Sets that meet in a shingle of their prefixes are candidates if lengths and places allow
that similarity; candidates are verified on the texts.

Only components are wanted, so not all pairs are made: first each set meets the first set of each of
its shingles and the one before it; then, in shingles that still have sets of several components, all pairs
of different components. Every linked pair is then either verified or within one component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from isochron.llm.common import cut, join_groups, row_keyed, salt, small_batches, stored
from isochron.llm.components import connected_components

BUCKETS = 1 << 16
BLOCK = 1024  # rows of a shingle that are compared with as many others in one task
SALTS = 64
CACHED_WORDS = 200_000
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_PRIME, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHED_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def shingle_set(text: str | None, size: int = 5, cache: _Words | None = None) -> np.ndarray:
    """Distinct hashes, in order, of the shingles of ``size`` words (A-Z lower-cased); fewer words make one shingle, none no shingle."""
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    own = np.fromiter(map((_Words() if cache is None else cache).__getitem__, words), np.uint64, len(words))
    k = min(size, len(own))
    h = np.full(len(own) - k + 1, k, np.uint64)
    for i in range(k):
        h = (h ^ own[i : len(own) - k + 1 + i]) * _PRIME
        h ^= h >> np.uint64(29)
    h *= _MIX
    return np.unique(h ^ h >> np.uint64(32))


def _features(docs: DataFrame, size: int) -> DataFrame:
    """row, n, s, t of each row's set (s, t: two sums that stand for it), and per task one row with a null row and counts by bucket."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, total = _Words(), np.zeros(BUCKETS, np.int64)
        kind = pa.list_(pa.int64())
        names = ["row", "n", "s", "t", "counts"]
        for b in batches:
            n, s, t = [], [], []
            for text in b.column(1).to_pylist():
                h = shingle_set(text, size, cache)
                total += np.bincount(h & np.uint64(BUCKETS - 1), minlength=BUCKETS) if len(h) > 4096 else 0
                if 0 < len(h) <= 4096:
                    np.add.at(total, (h & np.uint64(BUCKETS - 1)).astype(np.int64), 1)
                n.append(len(h))
                s.append(h.sum(dtype=np.uint64))
                t.append((h * h ^ h >> np.uint64(17)).sum(dtype=np.uint64))
            sums = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (s, t)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int32()), *sums, pa.nulls(len(n), kind)], names)
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.array([0], pa.int32()), pa.array([0], pa.int64()), pa.array([0], pa.int64()), pa.array([total.tolist()], kind)], names)

    return docs.select("__row", "text").mapInArrow(each, "row bigint, n int, s bigint, t bigint, counts array<bigint>")


def prefix_length(n, least: tuple[int, int]):
    a, b = least
    return n - (n * a + b - 1) // b + 1


def _prefixes(docs: DataFrame, counts: np.ndarray, size: int, least: tuple[int, int]) -> DataFrame:
    """h, row, n, p (place of h in the set), hot (h is of a bucket that may hold a frequent shingle) of the prefixes."""
    ranks = np.empty(BUCKETS, np.int64)
    ranks[np.argsort(counts, kind="stable")] = np.arange(BUCKETS)
    frequent = counts >= max(BLOCK, 2 * int(counts.mean()))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _Words()
        for b in batches:
            hs, lengths, places, sizes = [np.zeros(0, np.uint64)], [], [np.zeros(0, np.int64)], []
            for text in b.column(1).to_pylist():
                h = shingle_set(text, size, cache)
                k = prefix_length(len(h), least) if len(h) else 0
                order = np.lexsort((h, ranks[(h & np.uint64(BUCKETS - 1)).astype(np.int64)]))[:k]
                hs.append(h[order])
                places.append(np.arange(k))
                lengths.append(k)
                sizes.append(len(h))
            h, at = np.concatenate(hs), np.repeat(np.arange(len(lengths)), lengths)
            yield pa.RecordBatch.from_arrays(
                [pa.array(h.view(np.int64)), b.column(0).take(pa.array(at)), pa.array(np.array(sizes, np.int32)[at]), pa.array(np.concatenate(places).astype(np.int32)), pa.array(frequent[(h & np.uint64(BUCKETS - 1)).astype(np.int64)])],
                ["h", "row", "n", "p", "hot"],
            )

    return docs.select("__row", "text").mapInArrow(each, "h bigint, row bigint, n int, p int, hot boolean")


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows in order of h those whose h occurs twice, and all hot ones."""
    last = None  # the last row of the batch before, and whether it was given
    for b in batches:
        if not b.num_rows:
            continue
        h = b.column(0).to_numpy()
        same = h[1:] == h[:-1]
        keep = np.r_[False, same] | np.r_[same, False] | b.column(4).to_numpy(zero_copy_only=False)
        if last is not None and last[0].column(0)[0].as_py() == h[0]:
            keep[0] = True
            if not last[1]:
                yield last[0]
        yield b.filter(pa.array(keep))
        last = b.slice(b.num_rows - 1, 1), bool(keep[-1])


def _may(x: tuple[Column, Column], y: tuple[Column, Column], least: tuple[int, int]) -> Column:
    """Whether sets of n words that meet at place p, x and y as (n, p), may be similar."""
    a, b = least
    (n, p), (m, q) = x, y
    common = F.ceil((n + m) * F.lit(a) / F.lit(a + b))
    return (n * b >= m * a) & (m * b >= n * a) & (F.least(n - p, m - q) + F.least(p, q) >= common)


def _verified(pairs: DataFrame, docs: DataFrame, size: int, least: tuple[int, int]) -> DataFrame:
    """Those of ``pairs`` (a, b) whose texts' sets are similar enough."""
    up, down = least
    rows = pairs.select(F.explode(F.array("a", "b")).alias("__row")).distinct()
    needed = stored(docs.select("__row", "text").join(rows, "__row", "left_semi"))
    x, y = (needed.select(F.col("__row").alias(k), F.col("text").alias("t" + k)) for k in "ab")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _Words()
        for b in batches:
            alike, own = [], (None, None)
            for a, p, q in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if own[0] != a:
                    own = a, shingle_set(p, size, cache)
                v = shingle_set(q, size, cache)
                both = len(np.intersect1d(own[1], v, assume_unique=True))
                alike.append(both * (up + down) >= (len(own[1]) + len(v)) * up)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(alike, pa.bool_()))

    # the head of a large group has many pairs: a text goes only to the salts that its pairs have
    joined = pairs
    for own, other, texts in (("a", "b", x), ("b", "a", y)):
        salted = joined.withColumn("salt", salt(other, salts=SALTS))
        present = pairs.select(own, salt(other, salts=SALTS).alias("salt")).distinct()
        joined = salted.join(present.join(texts, own), [own, "salt"]).drop("salt")
    joined = joined.select("a", "b", "ta", "tb")
    with small_batches(docs.sparkSession, 500):
        return cut(joined.mapInArrow(compare, "a bigint, b bigint"))


def near_copies(docs: DataFrame, size: int = 5, least: tuple[int, int] = (4, 5)) -> DataFrame:
    """row, root of each row of ``docs`` (__row: a unique number that was written, text): root is the smallest row reachable over similar texts.

    Texts without words are alike.
    """
    spark = docs.sparkSession
    with small_batches(spark, 500):
        features = cut(_features(docs, size))
    counts = np.zeros(BUCKETS, np.int64)
    for r in features.where("row IS NULL").select(F.posexplode("counts").alias("k", "c")).groupBy("k").agg(F.sum("c").alias("c")).collect():  # BUCKETS rows
        counts[r.k] = r.c
    key = ["n", "s", "t"]
    rows = join_groups(features.where("row IS NOT NULL").select("row", *key), key, "row", [F.min("row").alias("__m")], [F.min("__m").alias("first")]).select("row", "first", "n")
    rows = cut(rows)
    firsts = rows.where("row = first AND n > 0").select(F.col("row").alias("__row"))
    texts = docs.select("__row", "text").join(firsts, "__row", "left_semi")
    with small_batches(spark, 200):
        dealt = _prefixes(texts, counts, size, least).withColumn("salt", F.when(F.col("hot"), salt("row", salts=SALTS)).otherwise(0))
        dealt = dealt.repartition("h", "salt").sortWithinPartitions("h").select("h", "row", "n", "p", "hot")
        met = stored(dealt.mapInArrow(_shared, dealt.schema).drop("hot"))

    large = cut(met.groupBy("h").agg(F.count("*").alias("k")).where(F.col("k") > BLOCK).select("h", F.ceil(F.col("k") / BLOCK * 1.5).cast("int").alias("blocks")))
    met = met.join(F.broadcast(large) if large.count() <= 50_000 else large, "h", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    met = met.withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int"))
    pair = lambda a, b: (F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    heads = join_groups(met, ["h"], "row", [F.min(F.struct("n", "row", "p")).alias("__m")], [F.min("__m").alias("o")])
    before = met.withColumn("o", F.lag(F.struct("n", "row", "p")).over(W.partitionBy("h", "block").orderBy("n", "row")))
    some = heads.unionByName(before.select(heads.columns)).where("o.row <> row").where(_may((F.col("n"), F.col("p")), (F.col("o.n"), F.col("o.p")), least))
    some = cut(some.select(*pair(F.col("row"), F.col("o.row"))).distinct())
    links = _verified(some, docs, size, least)

    roots = connected_components(links).withColumnRenamed("node", "row")
    rooted = met.join(roots, "row", "left").withColumn("root", F.coalesce("root", "row"))
    mixed = join_groups(rooted, ["h"], "row", [F.min("root").alias("__lo"), F.max("root").alias("__hi")], [F.min("__lo").alias("lo"), F.max("__hi").alias("hi")])
    mixed = stored(mixed.where("lo < hi").select("h", "row", "n", "p", "root", "blocks", "block"))
    x = mixed.select("h", "block", F.col("row").alias("a"), F.col("n").alias("an"), F.col("p").alias("ap"), F.col("root").alias("aroot"))
    y = mixed.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("h", "block", F.col("row").alias("b"), F.col("n").alias("bn"), F.col("p").alias("bp"), F.col("root").alias("broot"))
    rest = x.join(y, ["h", "block"]).where("a < b AND aroot <> broot").where(_may((F.col("an"), F.col("ap")), (F.col("bn"), F.col("bp")), least))
    rest = cut(rest.select("a", "b").distinct().join(some, ["a", "b"], "left_anti"))
    links = links.unionByName(_verified(rest, docs, size, least))
    roots = connected_components(links).withColumnRenamed("node", "first")
    found = cut(roots)
    return rows.join(F.broadcast(found) if found.count() <= 1_000_000 else found, "first", "left").select("row", F.coalesce("root", "first").alias("root"))


def drop_near_copies(docs: DataFrame, size: int = 5, least: tuple[int, int] = (4, 5)) -> DataFrame:
    """Of each component of similar texts one row of ``docs``, with all columns: that with the smallest doc_id (nulls last), of repeated ids any one."""
    keyed = row_keyed(docs)
    roots = near_copies(keyed, size, least)
    ids = keyed.select(F.col("__row").alias("row"), F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col("__row").alias("row")).alias("own"))
    stay = roots.join(ids, "row").groupBy("root").agg(F.min("own").alias("own")).select(F.col("own.row").alias("__row"))
    return keyed.join(stay, "__row", "left_semi").select(docs.columns)
