"""Argument checks, trajectories and evaluation reports against values worked out by hand."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from isochron.functions import arguments
from isochron.operators import trajectories

DOC = {"a": {"b": [1, "2", None, {"c": True}]}, "n": None, "s": [{"r": "x"}, {"q": 1}, {"r": "y"}, {"r": "x"}], "t": "12.5", "f": 2.0, "w": {"past_days": 3}}


@pytest.mark.parametrize(
    ("path", "found", "lost"),
    [("a.b.0", [1], False), ("a.b.-1.c", [True], False), ("a.b.2", [None], False), ("a.b.4", [], True), ("a.b.-5", [], True), ("n", [None], False), ("m", [], True), ("n.x", [], True), ("a.b.x", [], True), ("t.0", [], True),
     ("s.*.r", ["x", "y", "x"], False), ("s.*.z", [], False), ("a.*", [], True), ("s.*", [{"r": "x"}, {"q": 1}, {"r": "y"}, {"r": "x"}], False), ("s.*.r.z", [], False)],
)
def test_walk(spark, path, found, lost):
    df = spark.createDataFrame([(json.dumps(DOC), path)], "doc string, path string").select(arguments.walk(F.parse_json("doc"), F.col("path")).alias("w"))
    r = df.select(F.transform("w.found", lambda x: F.to_json(x)).alias("found"), "w.lost").first()
    assert [json.loads(x) for x in r.found] == found and r.lost is lost


def checked(spark, rows):
    df = spark.createDataFrame([(k, json.dumps(DOC), *r, dt.date(2026, 4, 21)) for k, r in enumerate(rows)], "k int, args string, path string, op string, value string, low double, high double, resolve boolean, today date")
    out = arguments.passed(df.withColumn("args", F.parse_json("args")).withColumn("value", F.parse_json("value")))
    return [r.ok for r in out.orderBy("k").select("ok").collect()]


def test_operators(spark):
    cases = [
        (("a.b.0", "eq", "1", None, None, False), True), (("a.b.0", "eq", "1.0", None, None, False), True), (("a.b.0", "eq", '"1"', None, None, False), False), (("a.b.3.c", "eq", "1", None, None, False), False),
        (("a.b.3.c", "eq", "true", None, None, False), True), (("f", "eq", "2", None, None, False), True), (("n", "eq", "null", None, None, False), True), (("m", "eq", "null", None, None, False), False),
        (("s.*.r", "eq", '["x", "y", "x"]', None, None, False), True), (("s.*.r", "eq", '["y", "x"]', None, None, False), False), (("s.*.r", "set_eq", '["y", "x"]', None, None, False), True), (("s.*.r", "set_eq", '["x"]', None, None, False), False),
        (("s.*.z", "set_eq", "[]", None, None, False), True), (("t", "set_eq", '["12.5"]', None, None, False), True), (("t", "set_eq", '"12.5"', None, None, False), True), (("a.b.1", "set_eq", "[2]", None, None, False), False),
        (("t", "present", None, None, None, False), True), (("n", "present", None, None, None, False), False), (("m", "present", None, None, None, False), False), (("s.*.z", "present", None, None, None, False), False),
        (("t", "present", None, 12.0, 13.0, False), True), (("t", "present", None, None, 12.0, False), False), (("a.b.3.c", "present", None, 0.0, None, False), False), (("s", "present", None, 0.0, 1.0, False), False),
        (("w.start_date", "eq", '"2026-04-18"', None, None, True), True), (("w.end", "eq", '"2026-04-20"', None, None, True), True), (("w.end", "eq", '"2026-04-21"', None, None, True), False), (("a.end", "eq", '"2026-04-27"', None, None, True), True),
        (("t.end", "eq", '"2026-04-27"', None, None, True), False), (("t", "other", "1", None, None, False), False),
    ]
    assert checked(spark, [c for c, _ in cases]) == [want for _, want in cases]


def test_windows(spark):
    today = dt.date(2026, 4, 21)
    day = lambda n: today + dt.timedelta(days=n)
    cases = {
        '{"start_date": "2026-01-01", "end_date": "2026-01-31"}': (dt.date(2026, 1, 1), dt.date(2026, 1, 31)), '{"start": "2026-01-01", "end": "2026-01-01"}': (dt.date(2026, 1, 1), dt.date(2026, 1, 1)),
        '{"past_days": 2}': (day(-2), day(-1)), '{"forecast_days": 2}': (day(0), day(1)), '{"past_days": 1, "forecast_days": 1}': (day(-1), day(0)), "{}": (day(0), day(6)),
        '{"start_date": "2026-01-01"}': None, '{"start_date": "2026-01-02", "end_date": "2026-01-01"}': None, '{"past_days": 0}': None, '{"start": "2026-01-01", "end": "2026-01-02", "past_days": 1}': None, "[1]": None, "3": None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "a string").select("a", arguments.resolved_window(F.parse_json("a"), F.lit(today)).alias("w"))
    assert {r.a: r.w and tuple(r.w) for r in df.collect()} == cases


def test_one_call_passes_all_checks(spark):
    cases = spark.createDataFrame([(1, dt.date(2026, 4, 21), ["plot"], ["sql"]), (2, dt.date(2026, 4, 21), ["plot"], []), (3, dt.date(2026, 4, 21), [], ["sql"]), (4, dt.date(2026, 4, 21), ["plot"], None)], "case_id int, today date, required array<string>, forbidden array<string>")
    calls = [(1, 1, "plot", {"a": 1, "b": 9}), (1, 2, "plot", {"a": 9, "b": 2}), (2, 1, "plot", {"a": 9}), (2, 2, "plot", {"a": 1, "b": 2}), (2, 3, "read", {}), (3, 1, "sql", {}), (4, 1, "plot", {"a": 1, "b": 2})]
    calls = spark.createDataFrame([(*c[:3], json.dumps(c[3])) for c in calls], "case_id int, call int, name string, args string").withColumn("args", F.parse_json("args"))
    checks = [(k, "plot", None, p, "eq", str(v)) for k in (1, 2) for p, v in (("a", 1), ("b", 2))] + [(2, "plot", "x", "a", "eq", "9"), (3, "plot", None, "a", "present", None)]
    checks = spark.createDataFrame([(*c, None, None, None) for c in checks], "case_id int, tool string, grp string, path string, op string, value string, low double, high double, resolve boolean").withColumn("value", F.parse_json("value"))
    groups = {(r.case_id, r.grp): (r.passed, r.missed) for r in trajectories.checked_groups(calls, checks, cases).collect()}
    assert groups == {(1, None): (False, 1), (2, None): (True, 0), (2, "x"): (True, 0), (3, None): (False, 1)}
    scores = {r.case_id: tuple(r)[1:] for r in trajectories.trajectory_scores(cases, calls, checks).collect()}
    assert scores == {1: (0, 0, 1, 0, 0.0), 2: (0, 0, 0, 1, 1.0), 3: (0, 1, 1, 1, 0.0), 4: (0, 0, 0, 0, 1.0)}


def test_comparison_counts_what_it_drops(spark):
    from isochron.operators import evaluation, statistics

    rows = [("s", "a", 1, 1, 1.0, False), ("s", "a", 1, 1, 3.0, False), ("s", "b", 1, 1, 4.0, False), ("s", "a", 1, 2, 9.0, False), ("s", "b", 2, 3, 1.0, False), ("s", "a", 2, 3, 0.0, True), ("s", "a", 2, 3, 0.0, False), ("s", "a", 3, 4, None, False), ("s", "b", 3, 4, 5.0, False), ("u", "a", 1, 1, 1.0, False)]
    df = spark.createDataFrame(rows, "split string, arm string, template_id int, case_id int, value double, excluded boolean")
    out = {r.split: r for r in evaluation.comparison(df, "a", "b", "value", resamples=50).collect()}
    assert (out["s"].baseline, out["s"].optimized, out["s"].difference, out["s"].low, out["s"].high, out["s"].cases, out["s"].dropped, out["s"].templates) == (2.0, 4.0, 2.0, 2.0, 2.0, 1, 3, 1)
    assert (out["u"].baseline, out["u"].low, out["u"].cases, out["u"].dropped, out["u"].templates) == (None, None, 0, 1, 0)
    assert evaluation.comparison(df.limit(0), "a", "b", "value").count() == 0


def test_resampled_by_hand(spark):
    import hashlib

    import numpy as np

    from isochron.operators import evaluation, statistics

    values = [0.5, 1.0, 4.0, 7.5, 2.0]
    df = spark.createDataFrame([("k", i, v) for i, v in enumerate(values)] + [("k", 9, None), ("one", 1, 3.0)], "key string, m int, v double")
    out = {r.key: r for r in evaluation.resampled(df, ["key"], "v", "m", 200, 7).collect()}
    pick = lambda r, i: values[int(hashlib.md5(f"7:{r}:{i}".encode()).hexdigest()[:8], 16) % 5]
    means = [np.mean([pick(r, i) for i in range(5)]) for r in range(200)]
    assert out["k"].n == 5 and out["k"].mean == pytest.approx(3.0)
    assert (out["k"].low, out["k"].high) == pytest.approx(tuple(np.quantile(means, [0.025, 0.975])))
    assert (out["one"].low, out["one"].high) == (3.0, 3.0)


def test_gaps_without_a_split(spark):
    from isochron.operators import evaluation, statistics

    rows = [("a", "train", 1, 1, 1.0), ("a", "test_seen", 1, 2, 0.5), ("a", "train", 2, 3, 1.0)]
    df = spark.createDataFrame(rows, "arm string, split string, template_id int, case_id int, value double")
    out = {r.to_split: r for r in evaluation.gaps(df, "value", resamples=20).collect()}
    assert (out["test_seen"].gap, out["test_seen"].low, out["test_seen"].high) == (0.5, 0.5, 0.5)
    assert (out["test_unseen"].from_value, out["test_unseen"].to_value, out["test_unseen"].gap, out["test_unseen"].low) == (0.5, None, None, None)


def test_answers(spark):
    from isochron.operators import evaluation, statistics

    cases = [
        ("true", "true", None, None, "exact", None, True), ("true", "1", None, None, "exact", None, False), ("true", '"true"', None, None, "exact", None, False), ("12.5", '" 12.5 "', "mm", "L", "exact", None, True), ("12.5", "12.6", "mm", "mm", "abs", 0.2, True),
        ("12.5", "12.5", "mm", "cm", "abs", 0.2, False), ("100", "102", "%θ", "%", "rel", 0.02, True), ("100", "103", "%", "%", "rel", 0.02, False), ("1", "true", None, None, "exact", None, False), ("1", "null", None, None, "exact", None, False), ("1", None, None, None, "exact", None, False),
        ('"dry"', '"dry"', None, None, "exact", None, True), ('"1"', '"1.0"', None, None, "exact", None, False), ("1", '"x"', None, None, "abs", 5.0, False),
    ]
    df = spark.createDataFrame(cases, "e string, a string, eu string, au string, kind string, tol double, want boolean")
    out = df.select("*", evaluation.answer_matches(F.parse_json("e"), F.parse_json("a"), F.col("eu"), F.col("au"), F.col("kind"), F.col("tol")).alias("got")).collect()
    assert [(r.e, r.a) for r in out if r.got is not r.want] == []


def test_containment(spark):
    from isochron.operators import evaluation, statistics

    rows = [(1, dt.date(2026, 4, 20), {"w": "2026-04-01..2026-04-21", "n": "no day 2026-13-01 or 12026-04-299", "l": '["2026-04-20"]', "none": None}), (2, dt.date(2026, 4, 20), {})]
    df = spark.createDataFrame(rows, "id int, as_of date, params map<string,string>")
    assert [(r.id, r.param, str(r.latest)) for r in evaluation.days_past(df, "id").collect()] == [(1, "w", "2026-04-21")]
    dim = spark.createDataFrame([("gravel", ["Kies"]), ("wetland", [])], "key string, aliases array<string>")
    cases = spark.createDataFrame([(1, {"a": " KIES", "b": "wetland", "c": "other"})], "id int, params map<string,string>")
    assert [(r.param, r.resolved) for r in evaluation.outside_pool(cases, "id", dim, ["gravel"]).collect()] == [("b", "wetland")]
    calls = [(1, "run", '{"evaluate_against_measured": true, "past_days": 3}'), (2, "run", '{"evaluate_against_measured": true, "forecast_days": 3}'), (3, "run", '{"forecast_days": 3}'), (4, "other", '{"evaluate_against_measured": true}'), (5, "run", '{"evaluate_against_measured": true, "past_days": 0}')]
    calls = spark.createDataFrame([(1, *c, dt.date(2026, 4, 20)) for c in calls], "id int, call int, name string, args string, today date").withColumn("args", F.parse_json("args"))
    assert sorted((r.call, r.ends and str(r.ends)) for r in evaluation.windows_past(calls, "id", "run").collect()) == [(2, "2026-04-22"), (5, None)]


def test_ledger_is_replaced_by_condition(spark, tmp_path):
    from isochron.operators import evaluation, statistics

    kind = "arm string, split string, repeat int, candidate_id int, served_model_id string, tokens int, cost double"
    rows = [("a", "s", 0, 1, "m", 10, 0.5), ("a", "s", 0, 2, None, 20, 0.25), ("b", "s", 0, 1, "n", 5, None)]
    path = str(tmp_path / "ledger")
    for part in (rows, rows[:2], rows[2:]):
        evaluation.write_ledger(spark.createDataFrame(part, kind), path)
    out = {r.arm: r for r in evaluation.ledger_summary(spark.read.parquet(path), ["arm"]).collect()}
    assert tuple(out["a"]) == ("a", 2, 2, 1, ["m"], 30, 0.75) and tuple(out["b"]) == ("b", 1, 1, 1, ["n"], 5, None)


def test_event_table(spark):
    from isochron.operators import islands

    events = spark.createDataFrame([(1, dt.date(2025, 6, 1), dt.date(2025, 6, 2)), (2, dt.date(2025, 6, 1), dt.date(2025, 6, 1))], "k int, start date, end date")
    at = lambda d, h: dt.datetime(2025, 6, d, h)
    rows = [(1, at(1, 1), 2.0, 0.5), (1, at(1, 7), 3.0, None), (1, at(2, 21), 1.0, 0.25), (1, at(2, 22), 9.0, 9.0), (1, dt.datetime(2025, 5, 31, 22), 4.0, None), (3, at(1, 1), 7.0, 7.0)]
    readings = spark.createDataFrame(rows, "k int, ts timestamp_ntz, value double, out double")
    found = {r.k: tuple(r)[3:] for r in islands.event_table(events, readings, ["k"], ["out"], per_day=2).collect()}
    assert found == {1: (10.0, 4, 1.0, 38.0, 0.75), 2: (None, 0, 0.0, None, None)}


def test_routes_and_roofs(spark):
    from isochron.plans import catalog

    a = spark.createDataFrame([(1, True), (2, False), (3, True), (4, None)], "k int, v boolean")
    b = spark.createDataFrame([(1, True), (2, True), (5, True)], "k int, v boolean")
    assert sorted(map(tuple, catalog.agreed(a, b, ["k"], "v").collect())) == [(1, True, True), (2, None, False), (3, None, False), (4, None, False), (5, None, False)]
    x = spark.createDataFrame([(1, 1.0), (2, 2.0)], "k int, v double")
    assert sorted(map(tuple, catalog.agreed(x, x.withColumn("v", F.col("v") + F.when(F.col("k") == 2, 0.1).otherwise(1e-12)), ["k"], "v").collect())) == [(1, 1.0, True), (2, None, False)]
    presets = spark.createDataFrame([("wetland", True), ("gravel", False)], "roof string, has_model boolean")
    asked = spark.createDataFrame([(k, r) for k, r in enumerate(("wetland", "gravel", "meadow", None))], "k int, roof string")
    assert {r.k: r.status for r in catalog.modellable(asked, "roof", presets).collect()} == {0: "available", 1: "excluded", 2: "unknown", 3: "unknown"}


def test_costs_and_lines(spark):
    from isochron.operators import evaluation

    usage = spark.createDataFrame([("r", "b", "m", 1_000_000), ("r", "b", "x", 3_000_000), ("r", "c", "m", None)], "role string, bucket string, model string, tokens bigint")
    prices = spark.createDataFrame([("m", 2.0)], "model string, eur_per_million double")
    assert sorted(map(tuple, evaluation.costs(usage, prices, ["role"]).collect())) == [("r", "b", 4_000_000, 2.0, 0.75), ("r", "c", 0, 0.0, 0.0)]
    compared = spark.createDataFrame([("s", 0.5, 0.75, 0.25, 0.1, 0.4, 3, 1, 2), ("u", None, None, None, None, None, 0, 4, 0)], "split string, baseline double, optimized double, difference double, low double, high double, cases int, dropped int, templates int")
    losses = spark.createDataFrame([("a", "s", "u", None, None, None)], "arm string, from_split string, to_split string, gap double, low double, high double")
    lines = [r.line for r in evaluation.text_report(compared, losses, "answer").orderBy("section", "at").collect()]
    assert lines == ["answer on s: 0.500 -> 0.750, difference +0.250 [+0.100, +0.400] over 2 templates, 3 cases, 1 dropped", "answer on u: none -> none, difference none (no interval) over 0 templates, 0 cases, 4 dropped", "answer of a from s to u: none (no interval)"]


def test_named_columns_and_json(spark):
    from isochron.operators import dimensions

    df = spark.createDataFrame([("a", 1.5, 2, "x"), ("b", float("nan"), 3, None), ("s", 2.0, 4, "y"), (None, 1.0, 5, "z")], "of string, a double, b int, s string")
    assert [r.value for r in dimensions.column_value(df, "of").orderBy("b").collect()] == [1.5, 3.0, None, None]
    typed = df.select("a", F.lit(dt.date(2025, 1, 2)).alias("d"), F.lit(b"\x01\xff").alias("raw"), F.lit("1.50").cast("decimal(5,2)").alias("n"), "s", F.array("b").alias("list"))
    assert [json.loads(r.row) for r in dimensions.json_safe(typed).collect()][:2] == [{"a": 1.5, "d": "2025-01-02", "raw": "01FF", "n": "1.50", "s": "x", "list": [2]}, {"a": None, "d": "2025-01-02", "raw": "01FF", "n": "1.50", "s": None, "list": [3]}]
    presets = dimensions.with_preset(spark.createDataFrame([("wetland", None), ("wetland", 0.3), ("meadow", 0.3)], "roof string, own double"), "roof", "own").collect()
    assert [(r.depth_cm, r.albedo, r.open_water, r.kg) for r in presets] == [(1.7, 0.06, True, 1.0), (1.7, 0.3, True, 1.0), (None, None, None, None)]


def test_checks_of_arguments_compute_each_step_once(spark):
    """Expressions that are named twice in a lambda or a branch are computed twice: the walk to a window's object was, fifteen times a row."""
    rows = spark.createDataFrame([(1, '{"a": {"b": 1}}', "a.b", "eq", "1", None, None, False, None)], "i int, a string, path string, op string, v string, low double, high double, resolve boolean, today date")
    done = arguments.passed(rows.select(F.parse_json("a").alias("args"), "path", "op", F.parse_json("v").alias("value"), "low", "high", "resolve", "today"))
    plan = done.select("ok")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("aggregate(") <= 2 and plan.count("map<string,variant>") + plan.count("MapType") <= 12


def test_places_in_lists_from_both_ends(spark):
    for path, found in (("l.0", ["1"]), ("l.-1", ["null"]), ("l.-3", ["1"]), ("l.2", ["null"]), ("l.3", []), ("l.-4", []), ("l.x", []), ("o.0", ["2"])):
        row = spark.range(1).select(arguments.walk(F.parse_json(F.lit('{"l": [1, "a", null], "o": {"0": 2}}')), path).alias("w")).select(F.transform("w.found", lambda x: F.to_json(x)).alias("f"), "w.lost").first()
        assert (row.f, row.lost) == (found, not found), path
