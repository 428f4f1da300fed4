import random

import pytest

from isochron.llm import line_dedup as ld

SCHEMA = "doc_id bigint, text string, extra string, line string, doc bigint, n int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y", 1, 2) for i, t in rows], SCHEMA)


def brute(rows, a=4, b=5):
    """Lines that stay: no earlier line, itself kept or not, has the same words or is similar."""
    seen, out = [], {}
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        out.setdefault(i, [])
        for k, line in enumerate((t or "").split("\n")):
            w = set(line.encode().split())
            if w:
                if all(len(w & v) * b < len(w | v) * a for v in seen):
                    out[i].append(k)
                seen.append(w)
    return out


def kept(spark, rows):
    return {r.doc_id: r.kept_lines for r in ld.kept_lines(frame(spark, rows)).collect()}


def test_small_cases(spark):
    rows = [(3, "a b c d e\nz"), (1, "a b c d e f\n \n\nb"), (2, None), (None, "q"), (4, ""), (5, "b\nq\n" + "w " * 5000)]
    assert kept(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert kept(spark, []) == {}


def mixed_rows(seed):
    rng = random.Random(seed)
    words = [f"w{int(rng.paretovariate(0.3))}" for _ in range(3000)] + ["the", "of"] * 200
    bases = [[rng.choice(words) for _ in range(rng.choice([3, 10, 30, 120, 400]))] for _ in range(25)]
    rows = []
    for i in range(150):
        lines = []
        for _ in range(rng.randint(0, 4)):
            line = list(rng.choice(bases))
            for _ in range(rng.choice([0, 0, 1, 2, 5])):
                line[rng.randrange(len(line))] = rng.choice(words)
            lines.append(" ".join(line))
        rows.append((i, "\n".join(lines)))
    return rows


@pytest.mark.parametrize("seed", [1, 4])
def test_against_brute_force(spark, seed):
    rows = mixed_rows(seed)
    assert kept(spark, rows) == brute(rows)


def test_a_group_of_near_copies_is_not_paired(spark, monkeypatch):
    rng = random.Random(5)
    base = [f"base{i}" for i in range(60)]
    rows = []
    for i in range(300):
        line = list(base)
        for _ in range(3):
            line[rng.randrange(60)] = f"own{rng.random()}"
        rows.append((i, " ".join(line)))
    made = []
    verified = ld.verified
    monkeypatch.setattr(ld, "verified", lambda pairs, *rest: made.append(pairs.count()) or verified(pairs, *rest))
    assert kept(spark, rows) == brute(rows)
    assert sum(made) < 300 * 5


def test_hot_words_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(ld, "HOT", 2)
    rows = mixed_rows(7)
    assert kept(spark, rows) == brute(rows)


def test_near_the_limit_nothing_is_lost(spark):
    rng = random.Random(9)
    base = [f"base{i}" for i in range(60)]
    rows = []
    for i in range(120):  # about half of these are similar to an earlier one
        line = list(base)
        for k in rng.sample(range(60), rng.randint(2, 9)):
            line[k] = f"own{rng.random()}"
        rows.append((i, " ".join(line)))
    assert kept(spark, rows) == brute(rows)


def test_rows_with_null_or_repeated_ids_are_documents_of_their_own(spark):
    rows = [(None, "a b c"), (None, "x y z"), (2, "a b c\nq"), (2, "q\nr"), (3, "x y z\nr")]
    out = sorted((r.doc_id if r.doc_id is not None else -1, r.n_lines, r.n_removed) for r in ld.kept_lines(frame(spark, rows)).collect())
    assert [r[:2] for r in out] == [(-1, 1), (-1, 1), (2, 2), (2, 2), (3, 2)]
    assert all(0 <= r[2] <= r[1] for r in out)
    assert sum(r[2] for r in out) == 4
    texts = [r.text for r in ld.drop_repeated_lines(frame(spark, rows)).collect()]
    assert len(texts) == 5 and sorted("\n".join(texts).split()) == sorted("a b c x y z q r".split())


def test_white_space_and_extra_columns(spark):
    rows = [(1, "a\tb  c\rd e"), (2, "  e d c b a "), (3, "a\u00a0b c\n\x0b\f"), (4, "a b c d e f")]
    assert kept(spark, rows) == brute(rows)


def test_texts(spark):
    rows = [(1, "a b c d e\nx"), (2, "a b c d e\n\ny"), (3, None), (4, "x")]
    out = {r.doc_id: (r.text, r.extra, r.n) for r in ld.drop_repeated_lines(frame(spark, rows)).collect()}
    assert out == {1: ("a b c d e\nx", "x", 2), 2: ("\ny", "x", 2), 3: (None, "x", 2), 4: ("", "x", 2)}


def test_a_line_is_dealt_to_few_bands_and_meets_all_lengths_it_may_be_like(spark):
    rows = [(n, 0, " ".join(f"w{k}" for k in range(n))) for n in range(1, 500)]
    distinct = spark.createDataFrame(rows, "doc bigint, pos int, line string")
    sets = {r.n: r for r in ld.line_sets(distinct, ld.bucket_ranks(distinct)[0], (4, 5)).collect()}
    assert sorted(sets) == list(range(1, 500))
    for n in range(1, 401):
        assert {sets[m].band for m in range(n, n * 5 // 4 + 1) if m in sets} <= {sets[n].band, sets[n].reach}
    assert sum(1 + (r.reach > r.band) for r in sets.values()) < 1.5 * len(sets)


def test_rarest_words_come_first(spark):
    rows = [(i, 0, f"own{i} the of and rare{i % 2}") for i in range(40)]
    distinct = spark.createDataFrame(rows, "doc bigint, pos int, line string")
    ranks, _ = ld.bucket_ranks(distinct)
    sets = ld.line_sets(distinct, ranks, (1, 5)).collect()  # prefixes of all words
    assert all(r.n == 5 and list(r.prefix) == sorted(r.prefix) for r in sets)
    assert len({r.prefix[0] for r in sets}) == 40 and len({r.prefix[1] for r in sets}) == 2
    assert len({tuple(sorted(r.prefix[2:])) for r in sets}) == 1


def test_lengths_about_those_where_parity_maps_grow(spark):
    rng = random.Random(11)
    rows = []
    for size in (70, 72, 75, 178, 180, 183):
        base = [f"s{size // 100}b{i}" for i in range(size)]
        for _ in range(12):
            line = list(base)
            for k in rng.sample(range(size), rng.randint(1, size // 6)):
                line[k] = f"own{rng.random()}"
            rows.append((len(rows), " ".join(line)))
    assert kept(spark, rows) == brute(rows)
