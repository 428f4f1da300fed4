"""Reports of an evaluation: comparisons with intervals, gaps between splits, arms and exclusions, diagnostics, containment of cases, ledgers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isochron.functions.arguments import resolved_window
from isochron.functions.text import canonical_key
from isochron.operators.statistics import case_means, resampled, template_means


def comparison(outcomes: DataFrame, left: str, right: str, value: str, resamples: int = 10_000, seed: int = 42) -> DataFrame:
    """Two arms on each split: split, baseline, optimized, difference, low, high, cases, dropped, templates.

    ``outcomes``: split, arm, template_id, case_id, excluded (boolean), and the value. A case counts if both arms have a value of it and no repeat in either was excluded; what the
    arms have besides is dropped, and counted. Means are over repeats, then cases, then templates; the interval is over the templates' differences.
    """
    case = ["split", "template_id", "case_id"]
    of = outcomes.where(F.col("arm").isin(left, right))
    both = case_means(of, ["split", "arm"], value).groupBy(*case).agg(F.max(F.when(F.col("arm") == left, F.col(value))).alias("a"), F.max(F.when(F.col("arm") == right, F.col(value))).alias("b"))
    lost = of.where(F.col("excluded")).select(*case).distinct().withColumn("lost", F.lit(True))
    marked = both.join(lost, case, "left").withColumn("paired", F.col("a").isNotNull() & F.col("b").isNotNull() & F.col("lost").isNull())
    counts = marked.groupBy("split").agg(F.count_if("paired").alias("cases"), F.count_if(~F.col("paired")).alias("dropped"))
    per = marked.where("paired").groupBy("split", "template_id").agg(F.avg("a").alias("a"), F.avg("b").alias("b")).withColumn("d", F.col("b") - F.col("a"))
    means = per.groupBy("split").agg(F.avg("a").alias("baseline"), F.avg("b").alias("optimized"), F.count("*").alias("templates"))
    interval = resampled(per, ["split"], "d", "template_id", resamples, seed).select("split", F.col("mean").alias("difference"), "low", "high")
    out = counts.join(means, "split", "left").join(interval, "split", "left").fillna(0, ["templates"])
    return out.select("split", "baseline", "optimized", "difference", "low", "high", "cases", "dropped", "templates")


def gaps(outcomes: DataFrame, value: str, train: str = "train", seen: str = "test_seen", unseen: str = "test_unseen", resamples: int = 10_000, seed: int = 42) -> DataFrame:
    """How much an arm loses from split to split: arm, from_split, to_split, from_value, to_value, gap, low, high.

    train to seen shares its templates, so its gap has an interval over their differences; seen to unseen does not, and is a point. Values weigh every template alike.
    """
    per = template_means(outcomes, ["arm", "split"], value)
    of = lambda split: F.avg(F.when(F.col("split") == split, F.col(value))).alias(split)
    values = per.groupBy("arm").agg(of(train), of(seen), of(unseen))
    wide = per.groupBy("arm", "template_id").agg(of(train), of(seen)).withColumn("d", F.col(train) - F.col(seen))
    interval = resampled(wide, ["arm"], "d", "template_id", resamples, seed).select("arm", "low", "high")
    side = lambda a, b: F.struct(F.lit(a).alias("from_split"), F.lit(b).alias("to_split"), F.col(a).alias("from_value"), F.col(b).alias("to_value"))
    rows = values.select("arm", F.explode(F.array(side(train, seen), side(seen, unseen))).alias("g")).select("arm", "g.*")
    joined = rows.join(interval, "arm", "left")
    paired = F.col("from_split") == train
    return joined.select("arm", "from_split", "to_split", "from_value", "to_value", (F.col("from_value") - F.col("to_value")).alias("gap"), F.when(paired, F.col("low")).alias("low"), F.when(paired, F.col("high")).alias("high"))


def arm_report(outcomes: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """keys, cases, included, excluded, and of each metric mean, scored, skipped and coverage over the included ones. A null in ``excluded`` is no exclusion."""
    inside = ~F.coalesce(F.col("excluded"), F.lit(False))
    of = []
    for m in metrics:
        v = F.when(inside, F.col(m))
        of += [F.avg(v).alias(f"{m}_mean"), F.count(v).alias(f"{m}_scored"), F.count_if(inside & F.col(m).isNull()).alias(f"{m}_skipped"), F.try_divide(F.count(v), F.count_if(inside)).alias(f"{m}_coverage")]
    return outcomes.groupBy(*keys).agg(F.count("*").alias("cases"), F.count_if(inside).alias("included"), F.count_if(~inside).alias("excluded"), *of)


def exclusions(outcomes: DataFrame, keys: list[str], sources: str = "sources") -> DataFrame:
    """keys, source, n: excluded cases by each of their sources; without any it is ``unknown``."""
    named = F.when(F.size(F.coalesce(F.col(sources), F.expr("CAST(array() AS array<string>)"))) > 0, F.col(sources)).otherwise(F.array(F.lit("unknown")))
    return outcomes.where("excluded").select(*keys, F.explode(named).alias("source")).groupBy(*keys, "source").agg(F.count("*").alias("n"))


def diagnostics(outcomes: DataFrame, keys: list[str], doc: str = "diagnostics") -> DataFrame:
    """Means and counts of what rollouts note beside their scores (JSON), over those not excluded.

    mean_steps, mean_extra_calls, mean_latency_s, mean_tokens (absent counts as 0), mean_fixer_iterations (absent is left out), parse_failures, step_cap_exceeded, rollouts.
    """
    at = lambda path: F.get_json_object(doc, f"$.{path}").try_cast("double")
    zero = lambda path: F.avg(F.coalesce(at(path), F.lit(0.0)))
    flag = lambda name: F.count_if(F.get_json_object(doc, f"$.{name}") == "true")
    return outcomes.where(~F.coalesce("excluded", F.lit(False))).groupBy(*keys).agg(
        zero("steps").alias("mean_steps"), zero("extra_calls").alias("mean_extra_calls"), zero("latency_s").alias("mean_latency_s"), zero("tokens.total").alias("mean_tokens"),
        F.avg(at("fixer_iterations")).alias("mean_fixer_iterations"), flag("parse_failure").alias("parse_failures"), flag("step_cap_exceeded").alias("step_cap_exceeded"), F.count("*").alias("rollouts"),
    )


def days_past(cases: DataFrame, case: str, params: str = "params", as_of: str = "as_of") -> DataFrame:
    """case, param, latest: parameters (a map of texts) that name a day after the case's own (a date). Any YYYY-MM-DD in a value counts if it is a day, alone, in a range, list or object."""
    long = cases.select(case, as_of, F.explode(params).alias("param", "value"))
    days = F.transform(F.regexp_extract_all("value", F.lit(r"(?<!\d)(\d{4}-\d{2}-\d{2})(?!\d)"), F.lit(1)), lambda d: d.try_cast("date"))
    return long.withColumn("latest", F.array_max(days)).where(F.col("latest") > F.col(as_of)).select(case, "param", "latest")


def outside_pool(cases: DataFrame, case: str, dim: DataFrame, pool: list[str], params: str = "params") -> DataFrame:
    """case, param, resolved: parameters whose value is a name or alias (``dim``: key, aliases) of something that is not in the pool. Other values name nothing and pass."""
    long = cases.select(case, F.explode(params).alias("param", "value")).withColumn("__a", canonical_key("value"))
    names = dim.select(F.col("key").alias("resolved"), F.explode(F.array_append("aliases", F.col("key"))).alias("__a")).groupBy(canonical_key("__a").alias("__a")).agg(F.min("resolved").alias("resolved"))
    return long.join(names, "__a").where(~F.col("resolved").isin(pool)).select(case, "param", "resolved")


def windows_past(calls: DataFrame, case: str, tool: str, flag: str = "evaluate_against_measured", today: str = "today") -> DataFrame:
    """case, call, ends: calls to ``tool`` that compare with measurements (a true ``flag`` among the arguments, a variant) over a window that ends after ``today``, or that is none (ends is null)."""
    compared = calls.where((F.col("name") == tool) & F.coalesce(F.try_variant_get("args", f"$.{flag}", "boolean"), F.lit(False)))
    window = compared.withColumn("ends", resolved_window(F.col("args"), F.col(today))["end"])
    return window.where(F.col("ends").isNull() | (F.col("ends") > F.col(today))).select(case, "call", "ends")


def generation_report(cases: DataFrame, rejections: DataFrame, wanted: DataFrame) -> DataFrame:
    """What a generation gave: section, key, n. Cases and abstentions by split, rejections by reason, attempts, shortfalls by template and split.

    ``cases``: split, template_id, abstains; ``rejections``: reason; ``wanted``: split, template_id, n.
    """
    part = lambda df, section, key, n: df.select(F.lit(section).alias("section"), key.cast("string").alias("key"), n.cast("bigint").alias("n"))
    by_split = cases.groupBy("split").agg(F.count("*").alias("n"), F.count_if("abstains").alias("a"))
    by_reason = rejections.groupBy("reason").agg(F.count("*").alias("n"))
    made = cases.groupBy("split", "template_id").agg(F.count("*").alias("made"))
    short = wanted.join(made, ["split", "template_id"], "left").withColumn("short", F.col("n") - F.coalesce("made", F.lit(0))).where("short > 0")
    attempts = part(by_split, "attempts", F.lit("all"), F.col("n")).unionByName(part(by_reason, "attempts", F.lit("all"), F.col("n"))).groupBy("section", "key").agg(F.sum("n").alias("n"))
    return (
        part(by_split, "cases", F.col("split"), F.col("n")).unionByName(part(by_split, "abstentions", F.col("split"), F.col("a"))).unionByName(part(by_reason, "rejections", F.col("reason"), F.col("n")))
        .unionByName(attempts).unionByName(part(short, "shortfalls", F.concat_ws("/", "split", "template_id"), F.col("short")))
    )


def write_ledger(rows: DataFrame, path: str) -> None:
    """Rollout rows as a columnar ledger, a folder for each arm, split and repeat; a condition that is written again replaces its own rows and no others, and what a lost task wrote does not count."""
    rows.repartition("arm", "split", "repeat").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("arm", "split", "repeat").parquet(path)


def ledger_summary(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, rollouts, candidates, witnessed, served (sorted names), tokens, cost: of a ledger (candidate_id, served_model_id, tokens, cost). The cost is null if any row has none."""
    return rows.groupBy(*keys).agg(
        F.count("*").alias("rollouts"), F.count_distinct("candidate_id").alias("candidates"), F.count("served_model_id").alias("witnessed"), F.sort_array(F.collect_set("served_model_id")).alias("served"),
        F.sum("tokens").alias("tokens"), F.when(F.count("cost") == F.count("*"), F.sum("cost")).alias("cost"),
    )


def split_integrity(splits: DataFrame, pool: DataFrame, item: str) -> DataFrame:
    """Per seed whether its splits cover the pool without overlap: seed, items, twice (items in several splits), missing, foreign, whole. ``splits``: seed, split, item."""
    per = splits.groupBy("seed", item).agg(F.count_distinct("split").alias("n"))
    every = pool.select(item).distinct().withColumn("known", F.lit(True))
    own = per.join(every, item, "left")
    counts = own.groupBy("seed").agg(F.count("*").alias("items"), F.count_if(F.col("n") > 1).alias("twice"), F.count_if("known").alias("known"))
    out = counts.withColumn("missing", F.lit(every.count()) - F.col("known")).withColumn("foreign", F.col("items") - F.col("known"))
    return out.select("seed", "items", "twice", "missing", "foreign", ((F.col("twice") == 0) & (F.col("missing") == 0) & (F.col("foreign") == 0)).alias("whole"))


def train_overlap(splits: DataFrame, item: str, split: str = "train") -> DataFrame:
    """a, b, shared, share: items that the train splits of two seeds share, of those of the first. A pair of seeds for each item they share, so seeds are few."""
    own = splits.where(F.col("split") == split).select("seed", item).distinct()
    sizes = own.groupBy(F.col("seed").alias("a")).agg(F.count("*").alias("size"))
    pairs = own.withColumnRenamed("seed", "a").join(own.withColumnRenamed("seed", "b"), item).where("a < b")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("shared")).join(sizes, "a").select("a", "b", "shared", (F.col("shared") / F.col("size")).alias("share"))


def replayable(cases: DataFrame, cached: DataFrame, key: str, refuses: str, order: str, limit: int | None = None) -> DataFrame:
    """Cases that can be run again without a fetch: those whose request is cached, and those that are to be refused; the first ``limit`` in order, if one is asked for."""
    known = cached.select(key).distinct().withColumn("__known", F.lit(True))
    kept = cases.join(known, key, "left").where(F.col(refuses) | F.col("__known")).drop("__known")
    return kept if limit is None else kept.orderBy(order).limit(limit)


def owned(requests: DataFrame, rows: DataFrame, key: str, owner: str) -> DataFrame:
    """Requests (key, owner) with the row of that key and owner, and found; what belongs to another is as absent as what is not there."""
    return requests.join(rows.withColumn("found", F.lit(True)), [key, owner], "left").withColumn("found", F.coalesce("found", F.lit(False)))


def answer_matches(expected: Column, actual: Column, expected_unit: Column, actual_unit: Column, kind: Column, tolerance: Column) -> Column:
    """Answers as variants: yes/no values match yes/no values only; numbers (also as text) need the same unit and lie within the tolerance; all else by its text.

    Litres (per square metre) and millimetres are one unit, and so are %θ and %. kind: exact, abs or rel. Never null.
    """
    unit = lambda u: F.coalesce(F.when(u == "L", "mm").when(u == "%θ", "%").otherwise(u), F.lit(""))
    kinds = F.schema_of_variant(expected), F.schema_of_variant(actual)
    boolean = tuple(k == "BOOLEAN" for k in kinds)
    wanted = F.when(~kinds[0].isin("STRING", "BOOLEAN", "VOID"), F.try_variant_get(expected, "$", "double"))
    given = F.when(~boolean[1], F.try_variant_get(F.coalesce(actual, F.parse_json(F.lit("null"))), "$", "double"))
    off = F.abs(given - wanted)
    near = F.when(kind == "abs", off <= tolerance).when(kind == "rel", off <= tolerance * F.abs(wanted)).otherwise(off == 0)
    text = lambda v: F.try_variant_get(v, "$", "string")
    ok = F.when(boolean[0], boolean[1] & (text(expected) == text(actual))).when(wanted.isNotNull(), (unit(expected_unit) == unit(actual_unit)) & near).otherwise(text(expected) == text(actual))
    return F.coalesce(ok, F.lit(False))


def text_report(compared: DataFrame, losses: DataFrame, metric: str) -> DataFrame:
    """Lines of a report: section, at, line. ``compared``: as ``comparison`` gives it; ``losses``: from_split, to_split, arm, gap, low, high, as ``gaps``. What has no value is said to have none."""
    said = lambda form: lambda c: F.when(F.col(c).isNotNull(), F.format_string(form, c)).otherwise("none")  # noqa: E731  a format writes a null as a part of the word
    number, plain = said("%+.3f"), said("%.3f")
    interval = lambda: F.when(F.col("low").isNotNull(), F.concat(F.lit(" ["), number("low"), F.lit(", "), number("high"), F.lit("]"))).otherwise(F.lit(" (no interval)"))
    count = lambda c: F.col(c).cast("string")
    first = F.concat(F.lit(f"{metric} on "), "split", F.lit(": "), plain("baseline"), F.lit(" -> "), plain("optimized"), F.lit(", difference "), number("difference"), interval(), F.lit(" over "), count("templates"), F.lit(" templates, "), count("cases"), F.lit(" cases, "), count("dropped"), F.lit(" dropped"))
    second = F.concat(F.lit(f"{metric} of "), "arm", F.lit(" from "), "from_split", F.lit(" to "), "to_split", F.lit(": "), number("gap"), interval())
    return compared.select(F.lit("comparison").alias("section"), F.col("split").alias("at"), first.alias("line")).unionByName(losses.select(F.lit("gap").alias("section"), F.concat_ws("/", "arm", "from_split").alias("at"), second.alias("line")))


def costs(usage: DataFrame, prices: DataFrame, keys: list[str]) -> DataFrame:
    """keys, bucket, tokens, eur, unmetered: tokens and their price by bucket of use. ``usage``: keys, bucket, model, tokens; ``prices``: model, eur_per_million.

    eur is that of the priced tokens; unmetered is the share of the tokens whose model has no price, which makes eur a lower bound. A null number of tokens counts as none.
    """
    priced = usage.join(prices, "model", "left").withColumn("__t", F.coalesce("tokens", F.lit(0)))
    return priced.groupBy(*keys, "bucket").agg(
        F.sum("__t").alias("tokens"), F.sum(F.col("__t") / 1e6 * F.coalesce("eur_per_million", F.lit(0.0))).alias("eur"),
        F.coalesce(F.try_divide(F.sum(F.when(F.col("eur_per_million").isNull(), F.col("__t")).otherwise(0)), F.sum("__t")), F.lit(0.0)).alias("unmetered"),
    )


def curve_ends(points: DataFrame, keys: list[str], at: str, value: str) -> DataFrame:
    """keys, first, last, best, best_at, improved: the ends of a learning curve, its best point (the earlier of equal ones) and whether the last is better than the first."""
    out = points.groupBy(*keys).agg(F.min_by(value, at).alias("first"), F.max_by(value, at).alias("last"), F.max(value).alias("best"), F.min_by(at, F.struct(-F.col(value), F.col(at))).alias("best_at"))
    return out.withColumn("improved", F.col("last") > F.col("first"))


def variants(cases: DataFrame, key: str, value: str, deltas: list[float], least: float, most: float) -> DataFrame:
    """Cases with their value and its neighbours at the given distances, as far as they stay within bounds: key, delta, variant. The distance 0 is the case itself."""
    rows = cases.select(key, value, F.explode(F.array(*(F.lit(float(d)) for d in sorted({0.0, *deltas})))).alias("delta"))
    return rows.withColumn("variant", F.col(value) + F.col("delta")).where(F.col("variant").between(least, most)).select(key, "delta", "variant")


def unmatched(rows: DataFrame, known: DataFrame, key: str, keys: list[str] | None = None) -> DataFrame:
    """keys, rows, unmatched: how many rows have a key that ``known`` lacks; a null key is one of those."""
    there = known.select(key).distinct().withColumn("__there", F.lit(True))
    return rows.join(there, key, "left").groupBy(*(keys or [])).agg(F.count("*").alias("rows"), F.count_if(F.col("__there").isNull()).alias("unmatched"))
