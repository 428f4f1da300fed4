import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from isochron.llm import simhash as sh
from isochron.llm.components import connected_components


def brute_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    hs = [xxhash.xxh64(" ".join(w[i : i + 4]).encode(), seed=42).intdigest() for i in range(max(1, len(w) - 3))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_roots(fps, most):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(np.array(fps, np.uint64) ^ np.uint64(fps[i])) <= most):
            root[max(find(i), find(int(j)))] = min(find(i), find(int(j)))
    return [find(i) for i in range(len(fps))]


def test_fingerprints():
    texts = ["", None, " \t", "One", "one two\x0bTHREE", "É é x y z", "a b c d " * 50, "x\x1cy z w v u", "w " * 30_000]
    assert [sh.fingerprint(t or "") for t in texts] == [brute_fingerprint(t) for t in texts]


def test_components_against_brute_force(spark, monkeypatch):
    rng = random.Random(1)
    monkeypatch.setattr(sh, "_HALF", 16)  # so that large buckets are split
    values = []
    for _ in range(40):
        centre = rng.getrandbits(64)
        for _ in range(rng.choice([1, 2, 60])):
            v = centre
            for b in rng.sample(range(64), rng.randint(0, 3)):
                v ^= 1 << b
            values.append(v)
    values = sorted(set(values))
    df = spark.createDataFrame([(sh._signed(v),) for v in values], "fp bigint")
    n, both = sh.bit_moments(df)
    assert n == len(values)
    for parts in (sh.plan(n, both, 4), [(list(range(0, 21)), 0), (list(range(21, 42)), 1), (list(range(42, 64)), 1)]):
        assert sum(t + 1 for _, t in parts) == 5
        links = sh.link(df, parts, 4)
        found = {r.node & (1 << 64) - 1: r.root for r in connected_components(links).collect()}
        want = brute_roots(values, 4)
        groups = {}
        for v, r in zip(values, want, strict=True):
            groups.setdefault(r, []).append(v)
        for g in groups.values():
            assert len({found.get(v, v) for v in g}) == 1
        assert len(set(found.values())) == sum(len(g) > 1 for g in groups.values())


def test_rows(spark):
    rows = [(5, "same text here now"), (3, "same text here now"), (None, "same text here now"), (7, None), (2, ""), (9, "other words are these"), (9, "other words are these")]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id bigint, text string, fp int, component_id string")
    out = sorted(((r.doc_id is None, r.doc_id or 0, r.component_id, r.component_size) for r in sh.near_duplicates(df).collect()))
    assert out == [(False, 2, 2, 2), (False, 3, 3, 3), (False, 5, 3, 3), (False, 7, 2, 2), (False, 9, 9, 2), (False, 9, 9, 2), (True, 0, 3, 3)]
    assert sh.near_duplicates(df.limit(0)).count() == 0
    assert sorted(r.doc_id or 0 for r in sh.drop_near_duplicates(df).collect()) == [0, 2, 3, 9, 9]


def test_long_chains(spark):
    links = spark.range(1, 300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r.root for r in connected_components(links).collect()} == {1}
    assert connected_components(links.limit(0)).count() == 0
