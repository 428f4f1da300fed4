import os

import pytest

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data here")
def test_pipeline(spark):
    import corpus_pipeline as cp

    assert len(cp.STAGES) == 5
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for _, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == columns
        sizes.append(docs.count())
    assert sizes[1] >= 0.95 * sizes[0] and sizes[2] == sizes[1] and 0 < sizes[3] <= sizes[2]
    out = cp.run(spark, SF)
    assert out.columns == ["doc_id", "n_tokens", "ids"] and out.count() == sizes[4]
    assert out.where("n_tokens <> size(ids)").count() == 0


def test_null_and_repeated_ids(spark):
    import corpus_pipeline as cp

    texts = [f"{w} one two three four\nline {w} of its own {w}{w}" for w in ("ant", "bee", "cat", "dog", "elk", "fox")]
    ids = [None, None, 7, 7, 7, 8]
    df = spark.createDataFrame([(i, t, "s", len(t)) for i, t in zip(ids, texts, strict=True)], "doc_id bigint, text string, source string, n_chars bigint").repartition(3)
    rows = sorted((r.doc_id or 0, r.text) for r in cp.line_dedup(spark, df, "").collect())
    assert rows == sorted((i or 0, t) for i, t in zip(ids, texts, strict=True))
    mixed = [(r.doc_id or 0, r.text) for r in cp.mixing(spark, df, "").collect()]
    whole = {(i or 0, t) for i, t in zip(ids, texts, strict=True)}
    assert whole <= set(mixed) and len(mixed) <= 2 * len(texts)
    # 1.5 times all words are taken, each pass being the start of a row's own text
    assert sum(len(t.split()) for _, t in mixed) == round(1.5 * sum(len(t.split()) for t in texts))
    assert all(any(i == j and u.split()[: len(t.split())] == t.split() for j, u in whole) for i, t in mixed)


def test_near_dedup_is_by_simhash(spark):
    import corpus_pipeline as cp
    from isochron.llm.simhash import fingerprint

    words = [f"w{i * i % 101}" for i in range(400)]
    texts = [" ".join(words[:k] + [f"x{k}"] + words[k + 1 :]) for k in range(0, 400, 20)]
    pairs = [(a, b) for a in texts for b in texts if a < b and (fingerprint(a) ^ fingerprint(b)).bit_count() <= 4]
    far = next(t for t in (" ".join(words[k:] + words[:k] + ["end"] * k) for k in range(1, 400)) if min((fingerprint(t) ^ fingerprint(x)).bit_count() for x in texts) > 8)
    a, b = pairs[0]
    df = spark.createDataFrame([(None, a, "p"), (5, b, "q"), (5, far, "r"), (9, None, "s"), (10, " ", "t")], "doc_id bigint, text string, source string")
    assert sorted(r.source for r in cp.near_dedup(spark, df, "").collect()) == ["q", "r", "s"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data here")
def test_language_id_leaves_no_second_copy(spark):
    """What the stage returns is read from its input; a copy of its own stayed on disk through all later stages."""
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = cp.language_id(spark, docs, SF)
    assert kept.inputFiles() == docs.inputFiles() and 0 < kept.count() <= docs.count()
