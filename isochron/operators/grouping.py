"""Groups and splits: near-duplicates by shape or distance, stripes, group-aware train and test sets, stable order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from isochron.working import cut as _cut


def text_shape(sql: Column) -> Column:
    """A statement without what varies: literals masked, lower case, white space collapsed. An approximation of its syntax tree."""
    masked = F.regexp_replace(sql, r"'(?:[^']|'')*'", "?")
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(masked, r"\b\d+(?:\.\d+)?\b", "?")), r"\s+", " "))


def nearby_pairs(items: DataFrame, item: str, vector: str, most: float = 0.10, pivots: int = 64, block: int = 1024, held: int = 1 << 25) -> DataFrame:
    """Links a < b of items whose vectors' cosine distance is below ``most``: enough of them that whatever is linked is connected.

    Exact: a vector is entered in the cell of its nearest pivot and has to meet the cells of all pivots whose angle is at most the nearest
    one's and twice the widest angle of a link (triangle inequality). Equal vectors are linked to the first of them, which stands for all.
    Cells, laid end to end, are cut into some 16 groups, of ``block`` vectors at least and ``held`` bytes at most, and a vector goes to the
    pairs of its group with each group that it has to meet: at most 16 copies of it are dealt, until groups are of ``held`` bytes. Of a pair
    of groups a task holds the first; products are made in single precision, and what is close to ``most`` is told in double.
    A pair of groups gives a spanning forest of its links. Where vectors have no clusters the angles exclude little, and the work is that of all pairs.
    """
    kind, given = items.schema[item].dataType.simpleString(), items.schema[vector].dataType.simpleString()
    given = given if given == "array<float>" else "array<double>"
    unit = items.select(F.col(item).alias("i"), F.col(vector).cast(given).alias("v")).where(F.col("i").isNotNull())
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    unit = unit.where((norm > 0) & (norm < float("inf"))).withColumn("h", F.sha2(F.to_json("v"), 256))
    first = _cut(unit.groupBy("h").agg(F.min(F.struct("i", "v")).alias("own")).select("h", "own.i", "own.v"))
    copies = unit.select("h", "i").join(first.select("h", F.col("i").alias("a")), "h").where("a < i").select("a", F.col("i").alias("b"))
    drawn: dict[int, list] = {}
    for row in first.orderBy("h").limit(pivots).collect():
        drawn.setdefault(len(row.v), []).append(row.v)
    reach = 2 * np.arccos(1 - most) + 1e-6

    def units(v: np.ndarray) -> np.ndarray:
        v = v.astype(np.float64)
        return v / np.sqrt((v * v).sum(axis=1, keepdims=True))

    centers = {n: units(np.array(own)) for n, own in drawn.items()}

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, starts = batch.column(1).values.to_numpy(), batch.column(1).offsets.to_numpy()
            size = np.diff(starts)
            for n in np.unique(size):
                at = np.flatnonzero(size == n)
                v = units(np.stack([flat[starts[k] : starts[k + 1]] for k in at]))
                angles = np.arccos(np.clip(v @ centers[n].T, -1, 1)) if n in centers else np.zeros((len(v), 1))
                row, cell = np.nonzero(angles <= angles.min(axis=1, keepdims=True) + reach)
                near = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(len(v) + 1)), pa.int32()), pa.array(cell, pa.int32()))
                own = batch.take(pa.array(at))
                columns = [pa.array(np.full(len(v), n), pa.int32()), pa.array(angles.argmin(axis=1), pa.int32()), near, *own.columns]
                yield pa.RecordBatch.from_arrays(columns, ["dim", "cell", "near", "i", "v"])

    placed = first.select("i", "v").mapInArrow(cells, f"dim int, cell int, near array<int>, i {kind}, v {given}")
    total, before = F.sum("n").over(W.partitionBy("dim")), F.sum("n").over(W.partitionBy("dim").orderBy("cell")) - F.col("n")
    width = F.greatest(F.lit(block), F.least(F.ceil(total / 16), F.ceil(F.lit(held) / (F.col("dim") * (4 if given == "array<float>" else 8)))))
    spans = placed.groupBy("dim", "cell").agg(F.count("*").alias("n")).select("dim", "cell", "n", before.alias("before"), width.alias("width"))  # a row per pivot
    group = lambda at: F.floor(at / F.col("width")).cast("int")
    ends = F.struct("cell", F.sequence(group(F.col("before")), group(F.col("before") + F.col("n") - 1)).alias("groups"))
    ends = spans.groupBy("dim").agg(F.map_from_entries(F.collect_list(ends)).alias("ends"))
    rows = placed.join(F.broadcast(spans), ["dim", "cell"]).join(F.broadcast(ends), "dim")
    met_groups = F.array_distinct(F.flatten(F.filter(F.transform("near", lambda c: F.try_element_at("ends", c)), lambda x: x.isNotNull())))
    rows = rows.select("dim", group(F.col("before") + F.pmod(F.xxhash64("i"), F.col("n"))).alias("g"), F.explode(met_groups).alias("t"), "i", "v")
    rows = rows.select("dim", F.least("g", "t").alias("x"), F.greatest("g", "t").alias("y"), (F.col("g") > F.col("t")).alias("probe"), "i", "v")

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, names, entered, parent, piece = None, [], [], np.arange(0), 512  # rows whose products stay in a core's cache

        def roots(x: np.ndarray) -> np.ndarray:
            top = parent[x]
            while not np.array_equal(up := parent[top], top):
                top = up
            parent[x] = top
            return top

        def linked(one: tuple, two: tuple) -> tuple[np.ndarray, np.ndarray]:
            """Rows of the two pieces that are near each other."""
            (at, v, u), (to, w, z) = one, two
            like, slack = u @ z.T, 1.2e-7 * (u.shape[1] + 8)
            if like.max() <= 1 - most - slack:
                return np.arange(0), np.arange(0)
            x, y = np.nonzero(like > 1 - most - slack)
            if at == to:
                x, y = x[x < y], y[x < y]
            open_ = np.flatnonzero(like[x, y] <= 1 - most + slack)
            far = []
            for k in range(0, len(open_), piece):
                some = open_[k : k + piece]
                a, b = v[x[some]].astype(np.float64), w[y[some]].astype(np.float64)
                cosine = (a * b).sum(axis=1) / np.sqrt((a * a).sum(axis=1) * (b * b).sum(axis=1))
                far.append(some[~(1 - cosine < most)])
            if far:
                x, y = np.delete(x, np.concatenate(far)), np.delete(y, np.concatenate(far))
            return x + at, y + to

        for batch in batches:
            keys = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(4)]
            flat, starts = batch.column(5).values.to_numpy(), batch.column(5).offsets.to_numpy()
            turns = np.flatnonzero(np.any([c[1:] != c[:-1] for c in keys], axis=0)) + 1
            links = []
            for lo, hi in zip([0, *turns], [*turns, batch.num_rows], strict=True):
                if lo == hi:
                    continue
                key, probe = tuple(int(c[lo]) for c in keys[:3]), bool(keys[3][lo])
                if key != now:
                    now, names, entered, parent = key, [], [], np.arange(0)
                for at in range(lo, hi, piece):
                    to = min(at + piece, hi)
                    v = flat[starts[at] : starts[to]].reshape(to - at, -1)  # of one length within a key
                    own = len(parent), v.copy(), units(v).astype(np.float32)
                    parent = np.concatenate([parent, np.arange(len(parent), len(parent) + to - at)])
                    names += batch.column(4).slice(at, to - at).to_pylist()
                    if not probe:
                        entered.append(own)
                    for other in entered if probe or key[1] == key[2] else []:
                        x, y = linked(other, own)
                        while len(x):  # each tree that has a link is hung into one with a lower number
                            p, q = roots(x), roots(y)
                            apart = p != q
                            x, y, p, q = x[apart], y[apart], p[apart], q[apart]
                            tops, k = np.unique(np.maximum(p, q), return_index=True)
                            parent[tops] = np.minimum(p, q)[k]
                            links += [(names[x[j]], names[y[j]]) for j in k]
            links = [(min(pair), max(pair)) for pair in links if pair[0] != pair[1]]
            if links:
                kinds = batch.schema.field("i").type
                yield pa.RecordBatch.from_arrays([pa.array([u for u, _ in links], kinds), pa.array([w for _, w in links], kinds)], ["a", "b"])

    dealt = rows.repartition("dim", "x", "y").sortWithinPartitions("dim", "x", "y", "probe")
    return _cut(dealt.mapInArrow(met, f"a {kind}, b {kind}").unionByName(copies).distinct())  # so that the pairs are compared once


def components(links: DataFrame) -> DataFrame:
    """node, root: the smallest node reachable over ``links`` (a, b), by passing on the smallest label until nothing changes."""
    edges = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v"))).distinct()
    labels = edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("root"))
    moved = 1
    while moved:
        passed = edges.join(labels.withColumnRenamed("u", "v"), "v").groupBy("u").agg(F.min("root").alias("near"))
        step = labels.join(passed, "u").select("u", "root", F.least("root", "near").alias("new"))
        jump = step.select("u", "new").join(step.select(F.col("u").alias("new"), F.col("new").alias("far")), "new", "left")
        step = _cut(step.join(jump.select("u", F.coalesce("far", "new").alias("low")), "u").select("u", "root", F.least("new", "low").alias("new")))
        moved = step.where("new <> root").limit(1).count()
        labels = step.select("u", F.col("new").alias("root"))
    return labels.select(F.col("u").alias("node"), "root")


def shape_groups(items: DataFrame, item: str, shape: str) -> DataFrame:
    """item, group: equal shapes share the smallest item."""
    return items.select(item, F.min(item).over(W.partitionBy(shape)).alias("group"))


def stripe(items: DataFrame, order: list[str], splits: list[str], keys: list[str] | None = None) -> DataFrame:
    """Deals items to splits in turn, by position within keys."""
    index = F.row_number().over(W.partitionBy(*(keys or [F.lit(0)])).orderBy(*order)) - 1
    return items.withColumn("split", F.element_at(F.array(*map(F.lit, splits)), (F.pmod(index, F.lit(len(splits))) + 1).cast("int")))


def first_seen_ids(items: DataFrame, name: str, order: str) -> DataFrame:
    """Dense numbers of the values of ``name`` in order of their first appearance: name, id."""
    first = items.groupBy(name).agg(F.min(order).alias("__first"))
    return first.select(name, (F.dense_rank().over(W.partitionBy(F.lit(0)).orderBy("__first")) - 1).alias("id"))


def keep_one(rows: DataFrame, keys: list[str], order: list, last: bool = False) -> DataFrame:
    """The first (or last) row per keys in a stated order."""
    by = [F.desc(c) if last else F.asc(c) for c in order]
    return rows.withColumn("__n", F.row_number().over(W.partitionBy(*keys).orderBy(*by))).where("__n = 1").drop("__n")


def _in_hash_order(rows: DataFrame, keys: list[str], key: Column, seed: int | Column, value: Column) -> DataFrame:
    """``rows`` with __before: the sum of ``value`` over the rows of the same ``keys`` that come earlier in the order of the MD5 of seed and key.

    In two levels: sums of 65,536 ranges of the hash are totalled (that many rows a key), then rows are sorted within their range. No task has more than a range.
    """
    seed = seed if isinstance(seed, Column) else F.lit(seed)
    hashed = rows.withColumn("__by", F.md5(F.concat_ws(":", seed.cast("string"), key.cast("string")))).withColumn("__value", value).withColumn("__range", F.conv(F.substring("__by", 1, 4), 16, 10).cast("int"))
    sums = hashed.groupBy(*keys, "__range").agg(F.sum("__value").alias("__in"))
    sums = sums.select(*keys, "__range", (F.sum("__in").over(W.partitionBy(*(keys or [F.lit(0)])).orderBy("__range")) - F.col("__in")).alias("__first"))
    inner = W.partitionBy(*keys, "__range").orderBy("__by", key).rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = hashed.withColumn("__upto", F.sum("__value").over(inner)).join(sums, [*keys, "__range"])
    return placed.withColumn("__before", F.col("__first") + F.col("__upto") - F.col("__value")).drop("__by", "__value", "__range", "__first", "__upto")


def group_split(groups: DataFrame, share: float, seed: int) -> DataFrame:
    """Whole groups to train or test so that test gets about ``share`` of the items: group, split. ``groups``: group (unique), n.

    Groups in an order by hash of (seed, group) fill the test side until its share is reached; the one that crosses the border goes where less is off.
    """
    total = groups.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    run = _in_hash_order(groups.select("group", "n"), [], F.col("group"), seed, F.col("n"))
    return run.select("group", F.when(F.col("__before") + F.col("n") / 2 <= total * share, "test").otherwise("train").alias("split"))


def mini_batches(rows: DataFrame, key: str, size: int, epochs: int, seed: int) -> DataFrame:
    """``rows`` once for each epoch, with epoch, position (from 0) and batch: an order of its own for each epoch, cut into batches of ``size``; only the last may be smaller.

    ``key`` is unique: rows of one key come in any order. The order is that of the MD5 of (seed + epoch, key), so reruns and other engines agree; it is another one than a seeded generator's.
    """
    each = rows.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    placed = _in_hash_order(each, ["epoch"], F.col(key), F.lit(seed) + F.col("epoch"), F.lit(1))
    return placed.withColumnRenamed("__before", "position").withColumn("batch", F.expr(f"position DIV {int(size)}"))


def shuffled(rows: DataFrame, key: str, seed: int) -> DataFrame:
    """A stable random order: by hash of key and seed."""
    return rows.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key)


def elided(rows: DataFrame, order: list[str], ends: int = 10) -> DataFrame:
    """The first and last ``ends`` rows of a result of more than twice as many; else all. Column rank tells the place.

    Only the ends are sorted: each task keeps its own first and last rows, and the rest is counted. ``order``
    tells rows apart and has no nulls.
    """
    n = rows.count()
    number = lambda df, *by: df.withColumn("rank", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(*by)))  # noqa: E731  of a few rows
    if n <= 2 * ends:
        return number(rows, *order)
    last = [F.desc(c) for c in order]
    tail = number(rows.orderBy(*last).limit(ends), *last).withColumn("rank", (F.lit(n + 1) - F.col("rank")).cast("int"))
    return number(rows.orderBy(*order).limit(ends), *order).unionByName(tail)
