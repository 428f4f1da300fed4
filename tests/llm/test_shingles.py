import random

from isochron.llm import shingles as sg


def shingled(text):
    w = text.lower().split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def changed(rng, words, share):
    return [f"x{rng.randrange(10**9)}" if rng.random() < share else w for w in words]


def brute_roots(texts):
    sets, root = [shingled(t or "") for t in texts], list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, u in enumerate(sets):
        for j, v in enumerate(sets[:i]):
            if (not u and not v) or 5 * len(u & v) >= 4 * len(u | v):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(texts))]


def test_components_against_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(300)]
    texts = ["", None, "one", "One", "a b c", " \n", "a b c d"]
    for _ in range(25):
        base = rng.choices(vocabulary, k=rng.choice([8, 60, 200, 500]))
        texts += [" ".join(changed(rng, base, rng.choice([0, 0.01, 0.02, 0.04]))) for _ in range(rng.choice([1, 3, 8]))]
    common = rng.choices(vocabulary, k=100)
    texts += [" ".join(changed(rng, common, 0.02)) for _ in range(60)]
    rng.shuffle(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "__row bigint, text string").repartition(5)
    want = brute_roots(texts)
    assert 20 < len(set(want)) < len(texts) - 60
    for block in (1024, 16):
        monkeypatch.setattr(sg, "BLOCK", block)  # so that large groups are split
        assert {r.row: r.root for r in sg.near_copies(df).collect()} == dict(enumerate(want))


def test_stage_drops_near_copies(spark):
    import corpus_pipeline as cp

    rng = random.Random(5)
    rows, at = [], 0
    for _ in range(40):
        words = [f"w{rng.randrange(5000)}" for _ in range(300)]
        copy = list(words)
        for i in rng.sample(range(0, 300, 10), 5):  # at most 25 of 296 shingles: similarity 0.84 or more
            copy[i] += "x"
        rows += [(at, " ".join(words), "s"), (at + 1, " ".join(copy), "s")]
        at += 2
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    assert sorted(r.doc_id for r in cp.near_dedup(spark, df, "").collect()) == list(range(0, 80, 2))
    assert cp.near_dedup(spark, df.limit(0), "").count() == 0


def test_stage_with_null_and_repeated_ids(spark):
    import corpus_pipeline as cp

    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (1, "other words in this text"), (None, "a b c d e f"), (None, "only with no id here"), (None, "only with no id here"), (3, "third of them all"), (3, "third of them all")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    out = sorted((r.doc_id or 0, r.text) for r in cp.near_dedup(spark, df, "").collect())
    assert out == [(0, "only with no id here"), (1, "a b c d e f"), (1, "other words in this text"), (3, "third of them all")]
