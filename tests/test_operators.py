import datetime as dt

import pytest
from pyspark.sql import functions as F

from isochron.functions import et0, text, units
from isochron.operators import aggregates, dimensions, grouping, islands, joins, quality, series, sets, statistics
from isochron.plans import catalog, guarded, stores

D = dt.date


def test_paired_difference_is_not_the_difference_of_means(spark):
    df = spark.createDataFrame([(20.0, 12.0), (18.0, 14.0), (30.0, None)], "a double, b double")
    row = joins.paired_mean_difference(df, "a", "b").first()
    assert (row.mean_diff, row.pairs) == (6.0, 2)


def test_latest_before_with_cutoff(spark):
    at = dt.datetime
    df = spark.createDataFrame([(at(2026, 4, 1, 12), 5.0), (at(2026, 4, 10), 6.0), (at(2026, 4, 19, 12), None)], "ts timestamp_ntz, value double")
    row = joins.latest_before(df, at(2026, 4, 20)).first()
    assert (row.value, row.stale) == (6.0, True)
    assert joins.latest_before(df, at(2026, 4, 20), cutoff=at(2026, 4, 10)).first().value == 5.0
    assert joins.latest_before(df, at(2026, 3, 1)).count() == 0


def test_asof_join_equal_and_strict(spark):
    left = spark.createDataFrame([(1, "a", 10), (2, "a", 5), (3, "b", 10)], "id int, k string, ts int")
    right = spark.createDataFrame([("a", 10, 1.0), ("a", 7, 2.0), ("a", 9, None)], "k string, ts int, value double")
    assert {r.id: r.asof_value for r in joins.asof_join(left, right, ["k"]).collect()} == {1: 1.0, 2: None, 3: None}
    assert {r.id: r.asof_value for r in joins.asof_join(left, right, ["k"], allow_equal=False).collect()} == {1: 2.0, 2: None, 3: None}


def test_overlay_and_leftovers(spark):
    base = spark.createDataFrame([(D(2025, 1, 1), 1.0, 2.0), (D(2025, 1, 2), 3.0, 4.0)], "d date, precip double, tm double")
    forced = spark.createDataFrame([(D(2025, 1, 2), "precip", 9.0), (D(2025, 1, 5), "precip", 1.0)], "d date, field string, value double")
    assert [tuple(r) for r in joins.overlay(base, forced, "d", ["precip", "tm"]).orderBy("d").collect()] == [(D(2025, 1, 1), 1.0, 2.0), (D(2025, 1, 2), 9.0, 4.0)]
    assert joins.unmatched_forcings(base, forced, "d").count() == 1


def test_peak_day_refuses_ties(spark):
    df = spark.createDataFrame([(1, dt.datetime(2025, 1, 1, 12), 5.0), (1, dt.datetime(2025, 1, 2, 12), 5.0), (2, dt.datetime(2025, 1, 1, 12), 5.0)], "k int, ts timestamp_ntz, value double")
    out = {r.k: (r.d, r.ties) for r in aggregates.peak_day(df, ["k"]).collect()}
    assert out == {1: (None, 2), 2: (D(2025, 1, 1), 1)}


def test_zero_is_not_missing(spark):
    df = spark.createDataFrame([(1, 0.0), (2, None)], "k int, value double")
    assert {r.k: r.occurred for r in aggregates.occurred(df, ["k"]).collect()} == {1: False, 2: None}


def test_heat_runs_at_the_edge_are_not_answered(spark):
    days = [(1, D(2025, 7, 8) + dt.timedelta(days=k), 26.0) for k in range(4)] + [(2, D(2025, 7, 12) + dt.timedelta(days=k), 26.0) for k in range(3)]
    df = spark.createDataFrame(days, "k int, d date, value double")
    out = {r.k: (r.days_inside, r.days_across, r.answered) for r in islands.heat_days(df, ["k"], D(2025, 7, 10), D(2025, 7, 20)).collect()}
    assert out == {1: (0, 2, False), 2: (3, 3, True)}


def test_equal_runs_and_gaps(spark):
    at = lambda h: dt.datetime(2025, 1, 1, h)
    df = spark.createDataFrame([(1, at(h), v) for h, v in [(0, 1.0), (1, 1.0), (2, 2.0), (5, 1.0)]], "k int, ts timestamp_ntz, value double")
    assert sorted(r.length for r in islands.equal_runs(df, ["k"]).collect()) == [1, 1, 2]
    assert islands.max_gap(df, ["k"], at(0), at(10)).first().max_gap_hours == 5.0


@pytest.mark.parametrize("length, ok", [(23, True), (24, False)])
def test_stuck_sensors(spark, length, ok):
    start = dt.datetime(2025, 1, 1)
    rows = [(1, start + dt.timedelta(minutes=30 * i), 20.0 if i < length else 20.0 + i) for i in range(48)]
    df = spark.createDataFrame(rows, "k int, ts timestamp_ntz, value double")
    need = spark.createDataFrame([("r", 1, start, start + dt.timedelta(days=1), "point", 1, 0.0, 100.0, True), ("none", 2, start, start + dt.timedelta(days=1), "point", 1, None, None, True)],
                                 "req_id string, k int, start_ts timestamp_ntz, end_ts timestamp_ntz, kind string, days int, low double, high double, state boolean")
    out = {r.req_id: r for r in quality.judge(quality.measure(df, need, ["k"])).collect()}
    assert out["r"].ok == ok and out["r"].longest_run == max(length, 1)
    assert (out["none"].reason, out["none"].rows, out["none"].max_gap_hours) == ("coverage", 0, 24.0)


def test_series(spark):
    with pytest.raises(ValueError):
        series.prepare(["nothing"], {}, D(2025, 1, 1), D(2025, 1, 2))
    df = spark.createDataFrame([(1, D(2025, 1, 1) + dt.timedelta(days=i), float(i)) for i in range(40)], "k int, d date, v double")
    assert series.shown(df, ["k"], {"v": "mean"}, 40).count() == 6
    assert series.shown(df.where("v < 31"), ["k"], {"v": "mean"}, 31).count() == 31
    assert series.capped(df, 39)[1] and not series.capped(df, 40)[1]
    gaps = series.gaps(df.where("v <> 3 AND v < 30"), df, ["k"], D(2025, 1, 1), D(2025, 1, 31)).first()
    assert (gaps.gap_days, gaps.truncated) == (2, True)


def test_sets(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (2, None)], "a int, b string")
    assert sets.set_equal(a, a.distinct()).first().equal
    assert not sets.set_equal(a, a.where("a = 1")).first().equal
    empty = a.where("false")
    assert sets.row_f1(empty, empty).first().f1 == 1.0
    assert sets.row_f1(a, empty).first().f1 == 0.0


def test_statistics(spark):
    rows = [("t1", 1, 1.0), ("t1", 1, 0.0), ("t1", 2, 1.0), ("t2", 3, None), ("t2", 4, 0.5)]
    df = spark.createDataFrame(rows, "template_id string, case_id int, v double").withColumn("arm", F.lit("a"))
    assert statistics.grand_means(df, ["arm"], "v").first().v == pytest.approx((0.75 + 0.5) / 2)
    a, b = (statistics.bootstrap(statistics.template_means(df, ["arm"], "v"), ["arm"], "v", 500).first() for _ in range(2))
    assert a == b and a.low <= a.mean <= a.high
    pairs = spark.createDataFrame([(1, False, True)] * 9 + [(1, True, False)], "k int, before boolean, after boolean")
    assert statistics.mcnemar(pairs, ["k"], "before", "after").first().p == pytest.approx(0.021484375)
    score = statistics.selection_score({"answer": F.lit(1.0), "trajectory": F.lit(None).cast("double"), "arguments": F.lit(0.0), "abstention": F.lit(None).cast("double")})
    assert spark.range(1).select(score.alias("s")).first().s == pytest.approx(0.4 / 0.6)


def test_stores(spark):
    df = spark.createDataFrame([(1, i, p, 2.0) for i, p in enumerate([0.0, 30.0, 0.0])], "k int, i int, p double, e double")
    out = stores.bucket_series(df, ["k"], "i", "p", "e", F.lit(12.0), F.lit(2.0), F.lit(22.0)).orderBy("i").collect()
    assert [(r.store, r.outflow, r.loss) for r in out] == [(12.0, 0.0, None), (22.0, 19.0, 1.0), (20.0, 0.0, 2.0)]
    ladder = lambda s, t, refill=False, gaps=False: spark.range(1).select(stores.decision(F.lit(s), F.lit(t), F.lit(refill), F.lit(5.0), F.lit(10.0), F.lit(False), F.lit(gaps)).alias("r")).first().r
    assert [ladder(5.0, 30.0), ladder(6.0, 23.9), ladder(10.1, 24.0), ladder(10.0, 24.0, True), ladder(10.0, 24.0), ladder(1.0, 1.0, gaps=True)] == ["wilting", "no_heat", "sufficient", "refill", "dry", "missing_data"]


def test_et0_refuses_what_has_no_meaning(spark):
    c = F.lit(1.0)
    with pytest.raises(ValueError):
        et0.et0_terms(c, c, c, c, c, c, c, albedo=1.2)
    with pytest.raises(ValueError):
        et0.et0_terms(c, c, c, c, c, c, c, latitude=70.0)
    with pytest.raises(ValueError):
        units.fold("other", "x")


def test_text(spark):
    df = spark.createDataFrame([('so {"a": 1} and {"b": {"c": [1, 2]}} {broken',), (None,), ("none",)], "t string")
    assert [r.j for r in df.select(text.last_json_object(F.col("t")).alias("j")).collect()] == ['{"b":{"c":[1,2]}}', None, None]
    one = spark.range(1).select(
        text.without_thoughts(F.lit("<think>x\ny</think>```sql\nSELECT 1\n```")).alias("a"), text.json_has(F.lit('{"k": null}'), "k").alias("b"),
        text.number_in(F.lit("it is 12.5 mm"), F.lit("12")).alias("c"), text.json_at(F.lit('{"a": [{"b": 3}]}'), "a.0.b").alias("d"),
    ).first()
    assert tuple(one) == ("SELECT 1", True, False, "3")


def test_grouping(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 20)] + [(30, 31)], "a bigint, b bigint")
    assert {r.node: r.root for r in grouping.components(links).collect()} == {**{i: 1 for i in range(1, 21)}, 30: 30, 31: 30}
    vectors = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate([(1, 2.3, 3.9), (1, 2.3, 3.91), (3, -2, 0.1)])], "i int, v array<double>")
    assert [tuple(r) for r in grouping.nearby_pairs(vectors, "i", "v").collect()] == [(0, 1)]


def test_mcnemar_of_many_pairs(spark):
    from math import comb

    for b, c in ((0, 0), (0, 3), (20, 9), (400, 460), (5000, 5100)):
        df = spark.createDataFrame([("k", False, True)] * b + [("k", True, False)] * c + [("k", True, True)], "k string, x boolean, y boolean")
        n = b + c
        exact = min(1.0, 2 * sum(comb(n, i) for i in range(min(b, c) + 1)) / 2**n) if n else 1.0
        assert statistics.mcnemar(df, ["k"], "x", "y").first().p == pytest.approx(exact, rel=1e-8)


def test_leaks_of_phrases_dates_and_signs(spark):
    literals = spark.createDataFrame([(x,) for x in ("2025-06-01", "12.5 mm", "-3.5", "17", "small ring", "a\\Eb", "?", "known")], "literal string")
    texts = spark.createDataFrame([(1, "on 2025-06-01: 12.5 mm at -3.5, 17 in all, known"), (2, "2025-06-012 12.5 mmx 3.5 17.5 small rings ?"), (3, "a small ring. a\\Eb")], "text_id int, text string")
    found = {tuple(x) for x in joins.leaks(literals, texts, spark.createDataFrame([("well known.",)], "text string")).collect()}
    assert found == {("2025-06-01", 1), ("12.5 mm", 1), ("-3.5", 1), ("17", 1), ("small ring", 3), ("a\\Eb", 3)}


def test_leaks_are_those_of_the_pattern_and_come_once_a_text(spark, monkeypatch):
    import re

    literals = ["a", "1.5", "a b", "b a b", "-3", "(a)", "x,5", "5", "..a", "1.5x", "a\x00b", "\x01", "a\n", "é", "5,", "known", "1"]
    texts = ["a b a b a", "1.5x 1.5 1.5", "-3 3 -3", "1-3", "(a) a", "x,5 5,5 5", "..a .a ...a", "a\x00b", "a\x01b a b", "a\n", "1.a a", "5,,6", "5,x5", "é éa", "xé", "", None, "5.x", "a.1", "1,a 1", "known", "1.5,2 1", "5,"]
    rows = spark.createDataFrame([*enumerate(texts), (0, texts[0])], "text_id int, text string")
    # tokens as they were, by Python's classes of letters and digits
    held = lambda x, t: re.search(rf"(?<![^\W_])(?<!\d[.,]){re.escape(x)}(?![^\W_])(?![.,]\d)", t or "") and re.search(r"[^\W_]", x)
    wanted = sorted((x, i) for x in literals for i, t in [*enumerate(texts), (0, texts[0])] if x != "known" and held(x, t))
    seeds = spark.createDataFrame([("known,",)], "text string")
    given = spark.createDataFrame([(x,) for x in [*literals, None, "a"]], "literal string")
    for few in (joins._FEW, 0):
        monkeypatch.setattr(joins, "_FEW", few)
        assert sorted(tuple(r) for r in joins.leaks(given, rows, seeds).collect()) == wanted


def test_leaks_do_not_shuffle_texts(spark):
    rows = spark.range(1000).select(F.col("id").alias("text_id"), F.concat(F.lit("about 17, on 2025-06-01: "), F.col("id").cast("string")).alias("text"))
    plan = joins.leaks(spark.createDataFrame([("2025-06-01",), ("17",)], "literal string"), rows, spark.createDataFrame([("known",)], "text string"))
    assert plan.count() == 2000
    side = plan._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [__h" not in side and "sha2" not in side


def test_ends_of_a_result(spark):
    df = spark.range(100).withColumn("v", F.col("id") * 7 % 100)
    assert sorted((x.v, x["rank"]) for x in grouping.elided(df, ["v"], 3).collect()) == [(0, 1), (1, 2), (2, 3), (97, 98), (98, 99), (99, 100)]
    assert sorted(x["rank"] for x in grouping.elided(df.limit(5), ["v"], 3).collect()) == [1, 2, 3, 4, 5]


def test_guard(spark):
    when = dt.datetime(2026, 4, 20, 23, 30, tzinfo=dt.UTC)
    assert guarded.pinned("SELECT d AS today, r.now, now FROM r", when) == "SELECT d AS today, r.now, now FROM r"
    assert guarded.pinned("SELECT today() AS current_date, d.current_date, current_time", when) == "SELECT DATE '2026-04-21' AS current_date, d.current_date, '23:30:00'"
    at = dt.datetime(2026, 4, 20, 23, 30, tzinfo=dt.UTC)
    assert guarded.pinned("SELECT now(), 'now()', current_date -- now()", at) == "SELECT TIMESTAMP_NTZ '2026-04-20 23:30:00', 'now()', DATE '2026-04-21' -- now()"
    assert guarded.ask(spark, "SELECT id FROM range(5)", at, 3) == {"columns": ["id"], "rows": [{"id": 0}, {"id": 1}, {"id": 2}], "truncated": True}
    for bad in ("DROP TABLE x", "SELECT 1; SELECT 2", "CREATE TABLE x AS SELECT 1", "WITH a AS (SELECT 1) INSERT INTO t SELECT * FROM a"):
        with pytest.raises(ValueError):
            guarded.select_only(spark, bad)
    assert guarded.select_only(spark, "SELECT 'drop table; x' AS a").first().a == "drop table; x"


def test_guard_goes_by_the_parsed_tree(spark):
    spark.range(4).createOrReplaceTempView("guarded_t")
    spark.range(3).createOrReplaceTempView("guarded_u")
    good = {
        "WITH x AS (SELECT * FROM guarded_t) SELECT count(*) AS n FROM x JOIN guarded_u USING (id) WHERE id IN (SELECT id FROM guarded_u)": 3,
        "SELECT count(*) AS n, 'insert into x; -- ' AS `drop` FROM guarded_t -- delete from guarded_t;\n;": 4,
        "FROM guarded_t |> WHERE id > 1 |> AGGREGATE count(*) AS n": 2,
        "SELECT count(*) AS n FROM (SELECT id FROM guarded_t EXCEPT SELECT id FROM guarded_u)": 1,
        "SELECT (SELECT count(*) FROM guarded_u) AS n FROM guarded_t WINDOW w AS (ORDER BY id) LIMIT 1": 3,
    }
    for sql, n in good.items():
        assert guarded.select_only(spark, sql, {"guarded_t", "guarded_u"}).first().n == n
    bad = [
        "FROM guarded_t INSERT INTO guarded_u SELECT id", "EXPLAIN SELECT 1", "CACHE TABLE guarded_t", "SET a = b", "BEGIN SELECT 1; END", "EXECUTE IMMEDIATE 'DROP VIEW guarded_t'", "DESCRIBE guarded_t", "USE x", "", "nonsense",
        "SELECT reflect('java.lang.System', 'getenv')", "SELECT (SELECT max(java_method('a', 'b')) FROM guarded_t)", "SELECT x FROM (SELECT TRANSFORM(id) USING 'cat' AS (x) FROM guarded_t)", "SELECT * FROM parquet.`/etc/x`",
        "SELECT * FROM guarded_other", "MERGE INTO guarded_t USING guarded_u ON guarded_t.id = guarded_u.id WHEN MATCHED THEN DELETE",
    ]
    for sql in bad:
        with pytest.raises(ValueError):
            guarded.select_only(spark, sql, {"guarded_t", "guarded_u"})
    assert spark.table("guarded_t").count() == 4


def test_bounds_and_aliases(spark):
    dim = spark.createDataFrame([("gravel", ["Kies", "K"])], "key string, aliases array<string>")
    rows = spark.createDataFrame([(" kies ",), ("GRAVEL",), ("other",), (None,)], "name string")
    assert [r.resolved for r in dimensions.resolve_aliases(rows, "name", dim).orderBy(F.col("name")).collect()] == [None, "gravel", "gravel", None]


def test_nearby_vectors_against_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    centres = rng.normal(size=(60, 16))
    v = np.repeat(centres, 4, axis=0) + rng.normal(size=(240, 16)) * 0.3
    v = np.concatenate([v, np.repeat(v[:1], 20, axis=0)])
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    near = 1 - unit @ unit.T < 0.10
    want = list(range(len(v)))
    for _ in range(len(v)):
        want = [min(want[j] for j in np.flatnonzero(near[i])) for i in range(len(v))]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "i bigint, v array<double>")
    links = grouping.nearby_pairs(df, "i", "v", block=8).cache()
    assert all(r.a < r.b and near[r.a, r.b] for r in links.collect())
    root = {r.node: r.root for r in grouping.components(links).collect()}
    assert [root.get(i, i) for i in range(len(v))] == want


def test_sums_do_not_depend_on_order(spark):
    up, down = [0.1, 0.2, 0.3], [0.3, 0.2, 0.1]
    rows = [(k, i, v) for k, own in (("a", up), ("b", down), ("c", [float("nan"), 1.0, None]), ("d", [None] * 3), ("e", [1e300, 1.0, -1e300])) for i, v in enumerate(own)]
    df = spark.createDataFrame(rows, "k string, i int, v double").coalesce(1)
    out = {r.k: (r.s, r.m) for r in df.groupBy("k").agg(units.exact_sum("v").alias("s"), units.exact_mean("v").alias("m")).collect()}
    assert out["a"] == out["b"] == (0.6, 0.6 / 3) and out["d"] == (None, None) and out["e"][0] == 1.0 and str(out["c"][0]) == "nan"


def test_equal_totals_tie_in_any_order(spark):
    rows = [(u, dt.datetime(2024, 1, d, 10 + i), v) for u in (7, None) for d, own in ((14, [0.1, 0.2, 0.3]), (16, [0.3, 0.2, 0.1])) for i, v in enumerate(own)]
    df = spark.createDataFrame(rows, "user_id bigint, ts timestamp_ntz, value double").coalesce(1)
    assert sorted(tuple(r)[1:] for r in aggregates.peak_day(df, ["user_id"]).collect()) == [(None, 0.6, 2)] * 2


def test_an_event_that_all_flowed_out_of_keeps_nothing(spark):
    event = spark.createDataFrame([(1, D(2024, 1, 1), D(2024, 1, 3), 0.6)], "k int, start date, end date, rain_total double")
    out = spark.createDataFrame([(1, D(2024, 1, i + 1), v) for i, v in enumerate((0.1, 0.2, 0.3))], "k int, d date, value double").coalesce(1)
    assert tuple(catalog.event_retention(event, out, ["k"]).first())[4:] == (0.6, 0.0, False)


def test_resamples_are_drawn_without_a_row_for_each_draw(spark, monkeypatch):
    """Whole resamples in tasks, with the same numbers as the join of draws and members beyond the limit."""
    rows = [(g, m, float((m * 7 + g) % 11), m % 3 + 1) for g in (1, 2) for m in range(40 + g)] + [(None, 1, 1.0, 1), (1, 99, None, 1)]
    df = spark.createDataFrame(rows, "g int, m int, v double, w int")
    out = statistics.resampled(df, ["g"], "v", "m", 300, weight="w")
    assert "__i" not in out._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(statistics, "BROADCAST_MEMBERS", 0)
    joined = statistics.resampled(df, ["g"], "v", "m", 300, weight="w")
    assert "__i" in joined._jdf.queryExecution().optimizedPlan().toString() and out.columns == joined.columns
    mine, theirs = ({r.g: r for r in d.collect()} for d in (out, joined))
    assert mine.keys() == theirs.keys() == {1, 2}
    for g, r in mine.items():
        assert tuple(r) == pytest.approx(tuple(theirs[g]), rel=1e-12)
