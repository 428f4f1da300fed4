"""Sharding, the prefix trie and fill-in-the-middle against brute force."""

import hashlib
import math
import os
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from isochron.llm import fill_in_middle as fim
from isochron.llm import prefix_trie as pt
from isochron.llm import sharding
from isochron.operators import ranks


@pytest.fixture
def many_tasks(spark):
    """Sorts keep their tasks, however small."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


# sharding


def permutation_by_hand(x, n, seed=1):
    a = next(k for k in range(1, n + 2) if k * k >= n)
    b = -(-n // a)
    while True:
        left, right = divmod(x, b)
        for k in range(4):
            part = lambda half: int(hashlib.md5(f"{seed}:{k}:{half}".encode()).hexdigest()[:15], 16)  # noqa: B023, E731
            left, right = ((left + part(right)) % a, right) if k % 2 == 0 else (left, (right + part(left)) % b)
        x = left * b + right
        if x < n:
            return x


@pytest.mark.parametrize("n", [1, 2, 3, 5, 7, 26, 97, 1000, 1025])
def test_permutation(spark, n):
    out = spark.range(n).select("id", sharding.permuted(F.col("id"), n).alias("p")).withColumn("back", sharding.unpermuted(F.col("p"), n)).collect()
    assert sorted(r.p for r in out) == list(range(n)) and all(r.back == r.id for r in out)
    assert [r.p for r in sorted(out)] == [permutation_by_hand(x, n) for x in range(n)]


def test_permutation_of_many_and_other_seeds(spark):
    n = 10**12 + 39
    ids = spark.createDataFrame([(x,) for x in (0, 1, n - 1, n // 2, None)], "id bigint")
    out = ids.select("id", sharding.permuted(F.col("id"), n, 5).alias("p"), sharding.permuted(F.col("id"), n, 6).alias("q")).withColumn("back", sharding.unpermuted(F.col("p"), n, 5)).collect()
    assert all(r.back == r.id and (r.id is None or 0 <= r.p < n and r.p != r.q) for r in out)


def test_numbers_of_rows(spark, many_tasks):
    rows = [(random.Random(k).randrange(50), "same") for k in range(300)] + [(7, "same")] * 200 + [(None, None)] * 3
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    out = ranks.numbered(df, ["doc_id"]).orderBy("__row").collect()
    assert [r["__row"] for r in out] == list(range(len(rows)))
    assert [r.doc_id for r in out] == sorted((r[0] for r in rows), key=lambda x: -1 if x is None else x)
    assert ranks.numbered(df.limit(0), ["doc_id"]).count() == 0


def test_shards(spark, many_tasks):
    rows = [(k, f"text {k} é🙂") for k in range(200)] + [(500, "copy")] * 100 + [(k, "copy") for k in range(600, 700)] + [(None, "x"), (None, None), (3, None), (4, ""), (900, "long " * 50_000)]
    kind = "doc_id bigint, text string, shard string, slot string, law int"
    wide = spark.createDataFrame([(*r, "a", "b", 1) for r in rows], kind)
    out = sharding.shard_report(wide.repartition(6)).collect()
    assert out[0].asDict().keys() == {"doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"}
    digest = lambda t: (len((t or "").encode()) + 1, zlib.crc32((t or "").encode()))
    in_order = sorted(((-1 if i is None else i, *digest(t)) for i, t in rows))
    place = [permutation_by_hand(x, len(rows)) for x in range(len(rows))]
    want = sorted((*r, p % 8, p // 8) for r, p in zip(in_order, place, strict=True))
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in out) == want
    counts = [sum(r.shard == s for r in out) for s in range(8)]
    assert max(counts) - min(counts) <= 1
    assert all(sorted(r.slot for r in out if r.shard == s) == list(range(counts[s])) for s in range(8))
    again = sharding.shard_report(wide.coalesce(1)).collect()
    assert sorted(again, key=str) == sorted(out, key=str)
    assert sharding.shard_report(wide.limit(0)).count() == 0
    few = sharding.shard_report(wide.where("doc_id < 3")).collect()
    assert len({r.shard for r in few}) == 3 and {r.slot for r in few} == {0}


def test_written_shards(spark, tmp_path):
    df = spark.range(100).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"), F.lit(1).alias("slot"))
    sharding.write_shards(df, str(tmp_path / "s"), shards=3, rows_per_file=10)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert sorted(r.doc_id for r in back.collect()) == list(range(100))
    assert sorted((r.shard, r.slot) for r in back.collect()) == sorted((p % 3, p // 3) for p in range(100))
    assert len(os.listdir(tmp_path / "s" / "shard=0")) >= 4


# prefix trie


def trie_by_hand(rows):
    by = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            by.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {}
    for conv, turns in by.items():
        key = lambda t: (*t[:2], hashlib.sha256(f"{len(t[2].encode())} {t[2]} {t[3]}".encode()).digest())
        own[conv] = [t[2:] for t in sorted(turns, key=key)]
    full = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        full[c] = own.get(c - int(math.fmod(c, 100)), [])[:h] + turns[h:]
    members = {}
    for c, turns in full.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for node, of in members.items():
        below = [x for x in members if x[: len(node)] == node]
        kids = lambda x: sum(len(y) == len(x) + 1 and y[: len(x)] == x for y in members)
        ends = ",".join(str(c) for c in sorted(of) if len(full[c]) == len(node))
        saved = sum((len(members[x]) - 1) * len(x[-1][1]) for x in below if x)
        parent = min(members[node[:-1]]) if node else None
        out.append((min(of), len(node), parent, len(of), kids(node), sum(kids(x) == 0 for x in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def conversations(seed, n, turns=5):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(3 * n), n):
        for t in range(rng.choice([0, 1, 2, turns])):
            rows.append((c, t if rng.random() < 0.9 else None, rng.choice(["user", "assistant", None, ""]), rng.choice(["a", "b", "é🙂", "", None])))
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_trie(spark, many_tasks, seed):
    rows = conversations(seed, 60)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id bigint, turn bigint, role string, text string, depth int, node string").repartition(3)
    assert sorted(map(tuple, pt.conversation_trie(df).collect()), key=str) == trie_by_hand(rows)


def test_trie_of_copies_over_many_tasks(spark, many_tasks):
    rows = [(c, t, "user", f"turn {t}") for c in range(150) for t in range(8)]  # equal conversations
    rows += [(c, 0, "user", "turn 0") for c in range(200, 290)] + [(c, t, "user", f"turn {t}" if t < 7 else str(c)) for c in range(300, 330) for t in range(12)]
    rows += [(400, t, "user", f"long {t}") for t in range(300)] + [(-5, 0, None, None), (None, 0, "user", "turn 0"), (-5, 0, None, None)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(5)
    swept = pt.rebuilt(pt.turn_arrays(df)).select("conv_id", F.transform("turns", lambda t: t["digest"]).alias("digests"), F.transform("turns", lambda t: t["chars"]).alias("chars"))
    pieces = swept.orderBy("digests", "conv_id").mapInArrow(pt._sweep, pt._FIELDS).where("kind <> 'node' AND depth = 8").count()
    assert pieces > 3  # the copies are on both sides of borders
    assert sorted(map(tuple, pt.conversation_trie(df).collect()), key=str) == trie_by_hand(rows)


def test_ends_in_chunks(spark, many_tasks, monkeypatch):
    monkeypatch.setattr(pt, "CHUNK", 7)
    rows = [(c, 0, "user", "x") for c in range(400)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    assert sorted(map(tuple, pt.conversation_trie(df).collect()), key=str) == trie_by_hand(rows)


def test_no_conversations(spark):
    assert pt.conversation_trie(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")).count() == 0
    only = pt.prefix_trie(spark.createDataFrame([(3, []), (9, [])], "conv_id bigint, turns array<struct<digest:binary,chars:int>>")).collect()
    assert list(map(tuple, only)) == [(3, 0, None, 2, 0, 1, 0, hashlib.sha256(b"3,9").hexdigest())]


# fill in the middle


def middle_by_hand(doc_id, text):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text, re.DOTALL)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    lo, hi = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    a, b, c = ("".join(x) for x in (units[:lo], units[lo:hi], units[hi:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        form, out = "plain", text
    elif h[3] % 100 < 20:
        form, out = "spm", f"<S>{c}<P>{a}<M>{b}"
    else:
        form, out = "psm", f"<P>{a}<S>{c}<M>{b}"
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    plain = form == "plain"
    return (doc_id, len(units), form, None if plain else len(a), None if plain else len(b), sha(out), sha(text))


def test_fill_in_middle(spark):
    rng = random.Random(3)
    texts = ["", None, " ", "a", "<P>", "x <S> y", "<M", "<", ">", "<P", "P>", "S>", "\n\r\t \x00", "é🙂 mixed Text 12,5\nnext", "<<S><M", "word " * 60_000]
    texts += ["".join(rng.choice("aB <>PSM🙂\n") for _ in range(rng.randrange(12))) for _ in range(300)]
    rows = [*enumerate(texts), (None, "no id"), (5, "again"), (5, "again")]
    df = spark.createDataFrame([(i, t, "n", 3, "f") for i, t in rows], "doc_id bigint, text string, n string, form int, output string")
    found = sorted(map(tuple, fim.middle_report(df).collect()), key=str)
    assert found == sorted((middle_by_hand(*r) for r in rows), key=str)
    assert {r[2] for r in found} == {"plain", "psm", "spm"}
    assert fim.middle_report(df.limit(0)).count() == 0


def test_restored_is_strict(spark):
    rows = [("<P>a<S>b<M>c", "psm", "acb"), ("<S>b<P>a<M>c", "spm", "acb"), ("<S>b<P>a<M>c", "psm", None), ("a<P><S><M>", "psm", None), ("<P>a<S>b", "psm", None), ("<P>", "plain", "<P>"), (None, "psm", None), ("<P>a<S>b<M>c<M>", "psm", None)]
    df = spark.createDataFrame(rows, "output string, form string, want string")
    assert all(r.want == r.got for r in df.select("want", fim.restored(F.col("output"), F.col("form")).alias("got")).collect())
