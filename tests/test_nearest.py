import random
from difflib import SequenceMatcher

import pytest

from isochron.operators import nearest


def by_hand(queries, known):
    out = []
    for a in {q for q in queries if q is not None}:
        ranked = sorted((-SequenceMatcher(a=a, b=b).ratio(), b) for b in {k for k in known if k is not None} if b != a)
        out.append((a, ranked[0][1], round(-ranked[0][0], 9)) if ranked and ranked[0][0] < 0 else (a, None, 0.0))
    return sorted(out)


def texts(seed, n):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcdef ") for _ in range(rng.randrange(1, 40))) for _ in range(n // 3)]
    out = list(base)
    for t in base * 2:
        chars = list(t)
        for _ in range(rng.randrange(4)):
            k = rng.randrange(len(chars) + 1)
            chars[k : k + rng.randrange(2)] = rng.choice(["", "x", "ab", "é🙂"])
        out.append("".join(chars))
    return out


@pytest.mark.parametrize(("seed", "sizes", "looks"), [(1, (1, 2), 8), (2, (1, 2, 3, 4), 1), (3, (1,), 2)])
def test_nearest_is_exact(spark, seed, sizes, looks):
    queries = texts(seed, 40) + ["", None, "zzz", "~", "same", "same"]
    known = texts(seed, 60) + texts(seed + 9, 30) + ["", None, "same", "zz", "zz", "a" * 300, "ab" * 150]
    frame = lambda rows: spark.createDataFrame([(t, 1) for t in rows], "key string, a int")
    out = nearest.nearest_matches(frame(queries), frame(known), looks=looks, sizes=sizes).collect()
    assert sorted((r.key, r.best, round(r.ratio, 9)) for r in out) == by_hand(queries, known)


def test_nearest_of_nothing(spark):
    one = spark.createDataFrame([("a",)], "key string")
    assert [tuple(r) for r in nearest.nearest_matches(one, one).collect()] == [("a", None, 0.0)]
    assert nearest.nearest_matches(one.limit(0), one).count() == 0
    assert [tuple(r) for r in nearest.nearest_matches(one, one.limit(0)).collect()] == [("a", None, 0.0)]


def test_few_pairs_are_scored(spark, monkeypatch):
    made = []
    kept = nearest._scored
    monkeypatch.setattr(nearest, "_scored", lambda pairs: made.append(pairs.count()) or kept(pairs))
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(3, 9))) for _ in range(400)]
    base = [" ".join(rng.choice(words) for _ in range(6)) for _ in range(300)]
    near = [t.replace(t[k % 9], "x", 1) for k, t in enumerate(base)]
    df = spark.createDataFrame([(w,) for w in base + near], "key string")
    assert nearest.nearest_matches(df, df).where("ratio > 0.9").count() > 500
    assert sum(made) < 600 * 599 / 10
