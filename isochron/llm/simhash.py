"""SimHash near-dedup with generalised pigeonhole search.

Fingerprints of 64 bits link if at most ``most`` bits differ. The bits are dealt into parts, correlated
bits into the same part, and the parts get thresholds t_i (-1: unused) with sum(t_i + 1) = most + 1, so
that two linked fingerprints differ in at most t_i bits of some part i. A dynamic program picks the
thresholds, and the number of parts, by estimated rows and candidates. Every fingerprint is entered
under its value of part i and probes all values within t_i flipped bits; candidates are verified.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isochron.llm.common import cut, join_groups, row_keyed, salt
from isochron.llm.components import connected_components

BITS, SEED = 64, 42
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_HALF = 2048  # entered fingerprints compared at once


def fingerprint(text: str, size: int = 4) -> int:
    """Bits set in over half the XXH64 of the shingles of ``size`` words (A-Z lower-cased); 0 if there is no word.

    Shingles count as often as they occur; fewer words than ``size`` make one shingle.
    """
    # of the bytes of UTF-8, split() takes those for white space that the words leave out, and no others
    words = text.encode().translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(itertools.accumulate(map(len, words), lambda a, n: a + n + 1))
    starts = [0, *(e + 1 for e in ends)]
    view, digest = memoryview(joined), xxhash.xxh64_intdigest
    k = min(size, len(words))
    h = np.array([digest(view[s:e], SEED) for s, e in zip(starts, ends[k - 1 :], strict=False)], np.uint64)
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(h), 4096):
        ones += np.unpackbits(h[i : i + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, size: int = 4) -> DataFrame:
    """doc_id and fp (bigint, the bits as a signed number) of each row of ``docs`` (doc_id, text); null counts as empty."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t or "", size) for t in b.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(each, f"doc_id {kind}, fp bigint")


def _bits(fp: np.ndarray) -> np.ndarray:
    return np.unpackbits(fp.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def bit_moments(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints and, for each two bits, of those that have both: 64 x 64, over all rows of ``fps`` (fp)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, both = 0, np.zeros((BITS, BITS), np.int64)
        for b in batches:
            bits = _bits(b.column(0).to_numpy(zero_copy_only=False)).astype(np.float32)
            n, both = n + len(bits), both + (bits.T @ bits).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([n] * BITS), pa.array(range(BITS), pa.int32()), pa.array(both.tolist(), pa.list_(pa.int64()))], ["n", "i", "row"])

    parts = fps.select("fp").mapInArrow(count, "n bigint, i int, row array<bigint>").select("n", "i", F.posexplode("row").alias("j", "c"))
    total = np.zeros((BITS, BITS), np.int64)
    n = 0
    for r in parts.groupBy("i", "j").agg(F.sum("c").alias("c"), F.sum("n").alias("n")).collect():  # 4096 rows
        total[r.i, r.j], n = r.c, r.n
    return n, total


def group_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """The bits in ``parts`` groups of equal size (to one), each grown by the bit that correlates most with the group."""
    p = np.diag(both) / max(n, 1)
    cov = both / max(n, 1) - np.outer(p, p)
    sd = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    corr = np.abs(cov / np.outer(sd, sd))
    left, out = set(range(BITS)), []
    for k in range(parts):
        rest = sorted(left)
        group = [max(rest, key=lambda i: (sum(sorted(corr[i, rest])[-8:]), -i))]
        left.discard(group[0])
        while len(group) < BITS // parts + (k < BITS % parts):
            best = max(sorted(left), key=lambda i: (corr[i, group].sum(), -i))
            group.append(best)
            left.discard(best)
        out.append(sorted(group))
    return out


def thresholds(n: int, ones: np.ndarray, groups: list[list[int]], most: int) -> tuple[float, list[int]]:
    """Least estimated cost and the threshold of each group, by dynamic programming over the groups.

    A group with threshold t costs the rows that it makes (one entry and one probe for each value within
    t flips, for each fingerprint) and its candidates (pairs within t differing bits there, estimated
    from the shares of ones as if bits were independent, at least one pair in 2 ^ bits).
    """
    def cost(group: list[int], t: int) -> float:
        if t < 0:
            return 0.0
        flips = sum(math.comb(len(group), k) for k in range(t + 1))
        differ = np.zeros(t + 2)
        differ[0] = 1.0
        for i in group:
            q = 2 * ones[i] * (1 - ones[i])
            differ[1:] = differ[1:] * (1 - q) + differ[:-1] * q
            differ[0] *= 1 - q
        pairs = n * n * max(differ[: t + 1].sum(), flips / 2 ** len(group))
        return n * (1 + flips) * 100 + pairs

    table: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for g in groups:
        step: dict[int, tuple[float, list[int]]] = {}
        for spent, (c, chosen) in table.items():
            for t in range(-1, most + 1 - spent):
                if t + 1 + spent <= most + 1 and (spent + t + 1 not in step or c + cost(g, t) < step[spent + t + 1][0]):
                    step[spent + t + 1] = (c + cost(g, t), [*chosen, t])
        table = step
    return table[most + 1]


def plan(n: int, both: np.ndarray, most: int) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each used part: the cheapest of 1 to 2 * (most + 1) parts."""
    ones = np.diag(both) / max(n, 1)
    options = []
    for parts in range(1, 2 * (most + 1) + 1):
        groups = group_bits(n, both, parts)
        options.append((*thresholds(n, ones, groups, most), groups))
    _, chosen, groups = min(options, key=lambda o: o[0])
    return [(g, t) for g, t in zip(groups, chosen, strict=True) if t >= 0]


def link(fps: DataFrame, parts: list[tuple[list[int], int]], most: int) -> DataFrame:
    """Links (a, b) among distinct fingerprints ``fps`` (fp): enough of them that whatever is linked is connected.

    Buckets are values of a part. A bucket's entries, in blocks of at most ``_HALF``, meet its probes in
    numpy. Of the pairs within ``most`` bits a block returns a spanning forest, so that a group of any
    size gives as many links as members a block, not all pairs. Buckets with more entries than a block are dealt
    to several keys: entries by hash, probes to each.
    """
    masks = [sum(1 << b for b in g) for g, _ in parts]
    flips = [np.array([sum(1 << g[i] for i in c) for k in range(t + 1) for c in itertools.combinations(range(len(g)), k)], np.uint64) for g, t in parts]

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(fp), 2000):
                own = fp[at : at + 2000]
                for k, mask in enumerate(masks):
                    value = own.view(np.uint64) & np.uint64(mask)
                    probes = value[:, None] ^ flips[k][None, :]
                    m = probes.size
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(own) + m, k, np.int8)), pa.array(np.concatenate([value, probes.ravel()]).view(np.int64)), pa.array(np.concatenate([np.zeros(len(own), bool), np.ones(m, bool)])), pa.array(np.concatenate([own, np.repeat(own, flips[k].size)]))],
                        ["part", "value", "probe", "fp"],
                    )

    rows = fps.select("fp").mapInArrow(keys, "part byte, value bigint, probe boolean, fp bigint")
    entries = fps.select(F.explode(F.array(*(F.struct(F.lit(k).cast("byte").alias("part"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("value")) for k, m in enumerate(masks)))).alias("e"))
    large = entries.groupBy("e.part", "e.value").agg(F.count("*").alias("n")).where(F.col("n") > _HALF).select("part", "value", F.ceil(F.col("n") / _HALF * 1.5).cast("int").alias("blocks"))
    large = cut(large)
    if n_large := large.count():
        small = n_large <= 50_000  # of 24 bytes each
        rows = rows.join(F.broadcast(large) if small else large, ["part", "value"], "left")
        block = F.when(F.col("blocks").isNull(), F.array(F.lit(0))).when(F.col("probe"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")))
        rows = rows.select("part", "value", F.explode(block).alias("block"), "probe", "fp")
    else:
        rows = rows.select("part", "value", F.lit(0).alias("block"), "probe", "fp")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, entered, forest = None, np.zeros(0, np.uint64), {}
        for b in batches:
            part, value, blk, probe, fp = (c.to_numpy(zero_copy_only=False) for c in b.columns)
            fp = fp.view(np.uint64)
            new = np.flatnonzero((np.diff(part) != 0) | (np.diff(value) != 0) | (np.diff(blk) != 0)) + 1
            out: list[np.ndarray] = []
            for lo, hi in zip([0, *new], [*new, len(fp)], strict=True):
                if lo == hi:
                    continue
                key = (part[lo], value[lo], blk[lo])
                if key != now:
                    now, entered, forest = key, np.zeros(0, np.uint64), {}
                mid = lo + int(np.searchsorted(probe[lo:hi], True))
                if mid > lo:
                    entered = np.concatenate([entered, fp[lo:mid]])
                if len(entered) and hi > mid:
                    for at in range(mid, hi, _HALF):
                        probes = fp[at : min(hi, at + _HALF)]
                        i, j = np.nonzero(np.bitwise_count(entered[:, None] ^ probes[None, :]) <= most)
                        x, y = entered[i], probes[j]
                        keep = x < y
                        if keep.any():
                            out.append(_forest(x[keep], y[keep], forest))
            if out:
                found = np.concatenate(out).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])

    dealt = rows.repartition("part", "value", "block").sortWithinPartitions("part", "value", "block", "probe")
    return dealt.mapInArrow(verify, "a bigint, b bigint")


def _forest(x: np.ndarray, y: np.ndarray, parent: dict[int, int]) -> np.ndarray:
    """Of the pairs (x, y) those that join what ``parent`` (a union-find, updated) had apart."""
    def find(v: int) -> int:
        while parent.get(v, v) != v:
            parent[v] = parent.get(parent[v], parent[v])
            v = parent[v]
        return v

    kept = []
    for u, v in zip(x.tolist(), y.tolist(), strict=True):
        a, b = find(u), find(v)
        if a != b:
            parent[max(a, b)] = min(a, b)
            kept.append((u, v))
    return np.array(kept, np.uint64).reshape(-1, 2)


def _signed(v: int) -> int:
    return v - (1 << 64) if v >> 63 else v


def near_duplicates(docs: DataFrame, size: int = 4, most: int = 4) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, fingerprint, component_id, component_size.

    Documents whose fingerprints differ in at most ``most`` bits are linked; component_id is the
    smallest doc_id reachable. Texts without words have fingerprint 0 and are linked like any other.
    Null ids are linked as well but give no component_id, unless all of a component are null. Rows
    may repeat ids. Other columns are ignored. An empty table gives no rows.
    """
    fps = cut(fingerprints(docs, size).withColumn("row", F.monotonically_increasing_id()))
    distinct = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("docs")))
    n, both = bit_moments(distinct)
    roots = connected_components(link(distinct, plan(n, both, most), most))
    classes = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "first", "docs", F.coalesce("root", "fp").alias("root"))
    linked = join_groups(
        classes, ["root"], "fp", [F.min("first").alias("__f"), F.sum("docs").alias("__n")],
        [F.min("__f").alias("component_id"), F.sum("__n").alias("component_size")],
    ).select("fp", "component_id", "component_size")
    # a fingerprint may be that of many documents: its component goes to each of the salts they are dealt to
    return _attach(fps, linked).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "component_size")


def _attach(rows: DataFrame, classes: DataFrame, salts: int = 64) -> DataFrame:
    """``rows`` joined with ``classes`` by fp; a class goes only to the salts that rows have, so a hot one is split."""
    salted = rows.withColumn("salt", salt("row", salts=salts))
    present = salted.groupBy("fp", "salt").agg(F.lit(1).alias("__one")).drop("__one")
    return salted.join(present.join(classes, "fp"), ["fp", "salt"])


def drop_near_duplicates(docs: DataFrame, size: int = 4, most: int = 4) -> DataFrame:
    """The rows of ``docs`` whose doc_id is its component's smallest, with all their columns. Rows with a null id stay."""
    gone = near_duplicates(docs, size, most).where("doc_id <> component_id").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti")


def keep_first(docs: DataFrame, size: int = 4, most: int = 4) -> DataFrame:
    """Of each component one row of ``docs``, with all columns: that with the smallest doc_id (nulls last), of repeated ids any one."""
    keyed = row_keyed(docs)
    found = near_duplicates(keyed.select(F.col("__row").alias("doc_id"), "text"), size, most)
    ids = keyed.select("__row", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col("__row").alias("row")).alias("own"))
    stay = found.select(F.col("doc_id").alias("__row"), "component_id").join(ids, "__row").groupBy("component_id").agg(F.min("own").alias("own"))
    return keyed.join(stay.select(F.col("own.row").alias("__row")), "__row", "left_semi").select(docs.columns)
