"""Vectors that are near each other: dealt in a bounded number of copies, compared once."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from isochron.operators import grouping


def brute_groups(ids, vectors, most):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, v in enumerate(vectors):
        for j, w in enumerate(vectors[:k]):
            if len(v) == len(w) and 1 - v @ w / np.sqrt((v @ v) * (w @ w)) < most:
                a, b = find(ids[k]), find(ids[j])
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("kind, limits", [("float", {"block": 8}), ("float", {"block": 8, "held": 40 * 12 * 4}), ("double", {"block": 64}), ("double", {})])
def test_groups_of_near_vectors_against_brute_force(spark, kind, limits):
    rng = np.random.default_rng(7)
    vectors = []
    for n in (12, 5):
        centres = rng.normal(size=(40, n))
        own = np.repeat(centres, 4, axis=0) + rng.normal(size=(160, n)) * 0.25
        one = centres[:1] + rng.normal(size=(80, n)) * 0.02  # a large group
        vectors += [x.astype(np.float32).astype(float) for x in (*own, *one, *(own[:5] * 3), *own[:5])]
    order = rng.permutation(len(vectors))
    ids = [int(i) // 2 if i % 50 == 1 else int(i) for i in order]  # some ids have two vectors
    df = spark.createDataFrame([(i, vectors[k].tolist()) for i, k in zip(ids, order, strict=True)], f"i bigint, v array<{kind}>").repartition(3)
    links = grouping.nearby_pairs(df, "i", "v", pivots=16, **limits)
    assert links.where("a >= b").count() == 0
    root = {r.node: r.root for r in grouping.components(links).collect()}
    assert {i: root.get(i, i) for i in ids} == brute_groups(ids, [vectors[k] for k in order], 0.10)


def test_pairs_are_compared_once(spark):
    vectors = spark.range(300).select("id", F.transform(F.sequence(F.lit(1), F.lit(8)), lambda k: F.rand(3) - 0.5 + k * 0).alias("v"))
    links = grouping.nearby_pairs(vectors, "id", "v", block=8)
    assert "MapInArrow" not in links._jdf.queryExecution().executedPlan().toString()  # whoever reads the links twice does not search again
