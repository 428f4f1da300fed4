"""Statistics of evaluations: nested means, paired differences, bootstraps, exact tests, scores."""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from isochron.working import cut

#: Weights of the metrics in the selection score.
WEIGHTS = {"answer": 0.40, "trajectory": 0.30, "arguments": 0.20, "abstention": 0.10}
RESAMPLES, SEED, CONFIDENCE = 10_000, 42, 0.95
#: Members of all groups of a bootstrap that are sent to every task: some 10 MB.
BROADCAST_MEMBERS = 200_000


def case_means(outcomes: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean over repeats: keys, template_id, case_id, value. Null means skipped, not zero."""
    return outcomes.where(F.col(value).isNotNull()).groupBy(*keys, "template_id", "case_id").agg(F.avg(value).alias(value))


def template_means(outcomes: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean over repeats, then over cases: keys, template_id, value, cases."""
    return case_means(outcomes, keys, value).groupBy(*keys, "template_id").agg(F.avg(value).alias(value), F.count("*").alias("cases"))


def grand_means(outcomes: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Every template counts alike: keys, value, templates."""
    return template_means(outcomes, keys, value).groupBy(*keys).agg(F.avg(value).alias(value), F.count("*").alias("templates"))


def selection_score(metrics: dict[str, Column]) -> Column:
    """Weighted mean of the metrics that were not skipped (null); null if all were."""
    total = sum((F.when(c.isNotNull(), F.lit(WEIGHTS[k])).otherwise(0.0) for k, c in metrics.items()), F.lit(0.0))
    score = sum((F.coalesce(c * WEIGHTS[k], F.lit(0.0)) for k, c in metrics.items()), F.lit(0.0))
    return F.when(total > 0, F.try_divide(score, total))


def summary(outcomes: DataFrame, keys: list[str], value: str) -> DataFrame:
    """mean, scored, skipped, coverage of a metric."""
    return outcomes.groupBy(*keys).agg(F.avg(value).alias("mean"), F.count(value).alias("scored"), F.count_if(F.col(value).isNull()).alias("skipped"), (F.count(value) / F.count("*")).alias("coverage"))


def paired_templates(outcomes: DataFrame, left: str, right: str, value: str) -> DataFrame:
    """template_id, left, right, difference over cases that both arms scored."""
    per = case_means(outcomes, ["arm"], value)
    a = per.where(F.col("arm") == left).select("template_id", "case_id", F.col(value).alias("left"))
    b = per.where(F.col("arm") == right).select("template_id", "case_id", F.col(value).alias("right"))
    both = a.join(b, ["template_id", "case_id"])
    return both.groupBy("template_id").agg(F.avg("left").alias("left"), F.avg("right").alias("right"), F.avg(F.col("right") - F.col("left")).alias("difference"), F.count("*").alias("cases"))


def win_loss(outcomes: DataFrame, left: str, right: str, value: str) -> DataFrame:
    """Per template which arm has the higher mean: verdict is left, right, tie or no data."""
    per = template_means(outcomes, ["arm"], value)
    a = per.where(F.col("arm") == left).select("template_id", F.col(value).alias("left"))
    b = per.where(F.col("arm") == right).select("template_id", F.col(value).alias("right"))
    both = a.join(b, "template_id", "full_outer")
    verdict = F.when(F.col("left").isNull() | F.col("right").isNull(), "no data").when(F.col("right") > F.col("left"), "right").when(F.col("right") < F.col("left"), "left").otherwise("tie")
    return both.withColumn("verdict", verdict)


def nondeterminism(outcomes: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Share of the cases with several repeats whose results differ: repeated, differing, share."""
    per = outcomes.where(F.col(value).isNotNull()).groupBy(*keys, "case_id").agg(F.count("*").alias("n"), F.count_distinct(value).alias("v"))
    out = per.groupBy(*keys).agg(F.count_if(F.col("n") > 1).alias("repeated"), F.count_if((F.col("n") > 1) & (F.col("v") > 1)).alias("differing"))
    return out.withColumn("share", F.try_divide("differing", "repeated"))


def abstention(outcomes: DataFrame, keys: list[str]) -> DataFrame:
    """accuracy on unanswerable cases and false_abstention on answerable ones; each is null without such cases."""
    rate = lambda cond: F.avg(F.when(cond, F.col("abstained").cast("double")))
    return outcomes.groupBy(*keys).agg(rate(F.col("unanswerable")).alias("accuracy"), rate(~F.col("unanswerable")).alias("false_abstention"))


def _drawn_in_tasks(draws: DataFrame, numbered: DataFrame, seed: int) -> DataFrame:
    """__g, __m (the mean of the resample) of each row of ``draws`` (__g, __r). ``numbered`` (__g, __j, __v, __c) is sent to every task: counted before.

    The draws of a resample are the same for all groups but for the modulus; they are made once for those of a batch.
    """
    rows = sorted(tuple(r) for r in numbered.select("__g", "__j", "__v", "__c").collect())
    groups = {g: [(v, c) for *_, v, c in own] for g, own in itertools.groupby(rows, key=lambda r: r[0])}
    shared = draws.sparkSession.sparkContext.broadcast({g: np.array(own).T.copy() for g, own in groups.items()})

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = shared.value
        texts = [str(i).encode() for i in range(max((x.shape[1] for x in of.values()), default=0))]
        for batch in batches:
            todo = sorted(zip(batch["__r"].to_pylist(), batch["__g"].to_pylist(), strict=True))
            out = []
            for k, own in itertools.groupby(todo, key=lambda x: x[0]):
                own = [g for _, g in own]
                start = hashlib.md5(f"{seed}:{k}:".encode(), usedforsecurity=False)
                heads = []
                for t in texts[: max(of[g].shape[1] for g in own)]:
                    h = start.copy()
                    h.update(t)
                    heads.append(h.digest()[:4])
                heads = np.frombuffer(b"".join(heads), ">u4").astype(np.int64)
                for g in own:
                    n = of[g].shape[1]
                    total, items = of[g][:, heads[:n] % n].sum(axis=1)
                    out.append((g, float(total / items)))
            yield pa.RecordBatch.from_arrays([pa.array([g for g, _ in out], pa.int32()), pa.array([m for _, m in out], pa.float64())], ["__g", "__m"])

    return draws.select("__g", "__r").mapInArrow(draw, "__g int, __m double")


def resampled(members: DataFrame, keys: list[str], value: str, member: str, resamples: int = RESAMPLES, seed: int = SEED, confidence: float = CONFIDENCE, weight: str | None = None) -> DataFrame:
    """Percentile bootstrap over the members of each group: keys, mean, low, high, n. ``member`` tells a group's members apart; null values are left out.

    A draw is the MD5 of seed, resample and draw, modulo the number of members, so it is the same in any engine. Up to
    ``BROADCAST_MEMBERS`` members go to every task, which draws whole resamples; more are joined with the draws by number, and each resample is one partial sum. Groups with a null key are left out. The work is resamples times members. With a ``weight`` a member stands for that many
    items whose sum is its value: the mean is that of the items.
    """
    own = members.where(F.col(value).isNotNull()).dropna(subset=keys)
    count = F.col(weight).cast("double") if weight else F.lit(1.0)
    numbered = own.select(*keys, F.col(value).cast("double").alias("__v"), count.alias("__c"), (F.row_number().over(W.partitionBy(*keys).orderBy(member)) - 1).alias("__j"))
    numbered = cut(numbered)  # used by the counts, the members and their numbers
    sizes = numbered.groupBy(*keys).agg(F.count("*").alias("n"), (F.sum("__v") / F.sum("__c")).alias("mean"))
    sizes = sizes.withColumn("__g", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(*keys)))  # a row for each group
    # groups are few rows: their resamples are dealt to tasks by a stated number, which is not made less where rows are still few, and draw there
    tasks = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    draws = sizes.withColumn("__r", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1)))).repartition(tasks, "__r")
    if numbered.count() <= BROADCAST_MEMBERS:
        means = _drawn_in_tasks(draws, numbered.join(sizes.select(*keys, "__g"), keys), seed).join(F.broadcast(sizes), "__g")
    else:  # both sides are dealt out by number
        draws = draws.withColumn("__i", F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1)))
        drawn = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("__r").cast("string"), F.col("__i").cast("string"))), 1, 8), 16, 10).cast("bigint") % F.col("n")
        means = draws.withColumn("__j", drawn.cast("int")).join(numbered, [*keys, "__j"]).groupBy(*keys, "n", "mean", "__r").agg((F.sum("__v") / F.sum("__c")).alias("__m"))
    tail = (1 - confidence) / 2
    return means.groupBy(*keys, "mean", "n").agg(F.percentile("__m", F.lit(tail)).alias("low"), F.percentile("__m", F.lit(1 - tail)).alias("high"))


def bootstrap(values: DataFrame, keys: list[str], value: str, resamples: int = RESAMPLES, seed: int = SEED, confidence: float = CONFIDENCE) -> DataFrame:
    """Percentile bootstrap of the mean per keys: mean, low, high, n. Members (template means, a few dozen) are numbered in the order of their values; see ``resampled``."""
    return resampled(values, keys, value, value, resamples, seed, confidence)


def _log_factorial(n: Column) -> Column:
    """ln n!: the product up to 15, Stirling's series (to 1e-12) above."""
    x = n.cast("double") + 1
    series = (x - 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * x * x * x * x * x)
    return F.when(n > 15, series).otherwise(F.log(F.factorial(F.least(n, F.lit(15)).cast("int")).cast("double")))


def mcnemar(pairs: DataFrame, keys: list[str], before: str, after: str) -> DataFrame:
    """Exact two-sided McNemar test: gained, lost, p. p is 1 without discordant pairs.

    The binomial tail is its largest term times a sum of ratios to it; of those, 40 standard deviations
    hold all that a double can, so that millions of pairs take some ten thousand steps.
    """
    counts = pairs.groupBy(*keys).agg(F.count_if(~F.col(before) & F.col(after)).alias("gained"), F.count_if(F.col(before) & ~F.col(after)).alias("lost"))
    n, k = F.col("gained") + F.col("lost"), F.least("gained", "lost")
    largest = F.exp(_log_factorial(n) - _log_factorial(k) - _log_factorial(n - k) - n * math.log(2.0))
    steps = F.sequence(F.lit(0), F.least(k, F.ceil(20 * F.sqrt(n)) + 1))
    start = F.struct(F.lit(0.0).alias("all"), F.lit(1.0).alias("term"))
    tail = F.aggregate(steps, start, lambda acc, i: F.struct((acc["all"] + acc["term"]).alias("all"), (acc["term"] * (k - i) / (n - k + i + 1)).alias("term")), lambda acc: acc["all"])
    return counts.withColumn("p", F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * largest * tail)))


def delta_spread(deltas: DataFrame, keys: list[str], value: str) -> DataFrame:
    """mean, sd, ratio (absolute mean by sd; null for sd 0 or a single value)."""
    out = deltas.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    return out.withColumn("ratio", F.try_divide(F.abs("mean"), F.nullif("sd", F.lit(0.0))))


def tolerance_match(expected: Column, actual: Column, kind: Column, tolerance: Column) -> Column:
    """Numbers match: exact, within an absolute tolerance, or within a share of the expected one."""
    return F.coalesce(
        F.when(kind == "exact", expected == actual).when(kind == "abs", F.abs(expected - actual) <= tolerance).when(kind == "rel", F.abs(expected - actual) <= tolerance * F.abs(expected)), F.lit(False)
    )


def trajectory_score(called: Column, required: Column, forbidden: Column) -> Column:
    """1 if all required calls were made and no forbidden one."""
    return ((F.size(F.array_except(required, called)) == 0) & ~F.arrays_overlap(forbidden, called)).cast("double")


def recall(hits: Column, gold: Column) -> Column:
    """Share of the gold members that were hit; null without gold."""
    return F.try_divide(F.size(F.array_intersect(hits, gold)), F.nullif(F.size(F.array_distinct(gold)), F.lit(0)))


def cluster_bootstrap(values: DataFrame, keys: list[str], cluster: str, value: str, resamples: int = 20_000, seed: int = SEED, confidence: float = CONFIDENCE) -> DataFrame:
    """As ``bootstrap``, but whole clusters (all items of a question) are drawn: mean, low, high, n (clusters).

    A resample's mean is that of all items of the drawn clusters; clusters are reduced to sum and count first.
    """
    per = values.where(F.col(value).isNotNull()).groupBy(*keys, cluster).agg(F.sum(value).alias("__s"), F.count("*").alias("__n"))
    return resampled(per, keys, "__s", cluster, resamples, seed, confidence, weight="__n")


def gains(rows: DataFrame, keys: list[str], value: str, run: str) -> DataFrame:
    """mean, sd (0 for a single run), runs and their sorted names per keys."""
    return rows.groupBy(*keys).agg(F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("sd"), F.count_distinct(run).alias("runs"), F.sort_array(F.collect_set(run)).alias("names"))


def balanced_books(costs: DataFrame, keys: list[str], role: str, bucket: str, amount: str, relative: float = 1e-6) -> DataFrame:
    """Whether the sums by role and the sums by bucket agree per keys: by_role, by_bucket, agree. Rows without a role or bucket count on one side only."""
    sums = costs.groupBy(*keys).agg(F.sum(F.when(F.col(role).isNotNull(), F.col(amount))).alias("by_role"), F.sum(F.when(F.col(bucket).isNotNull(), F.col(amount))).alias("by_bucket"))
    return sums.withColumn("agree", F.abs(F.col("by_role") - F.col("by_bucket")) <= relative * F.abs("by_role"))


def steps_crossed(points: DataFrame, keys: list[str], at: str, spend: str, every: float) -> DataFrame:
    """Points at which the spend has crossed a further multiple of ``every``: checkpoints of a learning curve."""
    w = W.partitionBy(*keys).orderBy(at)
    mark = F.floor(F.col(spend) / every)
    marked = points.withColumn("mark", mark).withColumn("__before", F.lag(mark).over(w))
    return marked.where(F.coalesce(F.col("mark") > F.col("__before"), F.col("mark") > 0)).drop("__before")
