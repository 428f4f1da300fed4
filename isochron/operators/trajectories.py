"""Scores of what an agent called: required and forbidden tools, checks of arguments that one call must pass together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isochron.functions.arguments import passed


def checked_groups(calls: DataFrame, checks: DataFrame, cases: DataFrame, case: str = "case_id") -> DataFrame:
    """case, tool, grp, passed, missed: whether one call to the tool passes all checks of the group, and how many the closest call misses (all, if the tool was never called).

    ``calls``: case, call (unique in its case), name, args (variant); ``checks``: case, tool, grp (null for the tool's common group), path, op, value
    (variant), low, high, resolve; ``cases``: case, today (date). Calls and checks meet by case and tool: as many rows as a case's calls to a tool times its checks of it.
    """
    of_case = checks.join(cases.select(case, "today"), case)
    many = of_case.groupBy(case, "tool", "grp").agg(F.count("*").alias("checks"))
    made = calls.select(case, F.col("name").alias("tool"), "call", "args").join(of_case, [case, "tool"])
    made = passed(made.withColumn("resolve", F.coalesce("resolve", F.lit(False))))
    per_call = made.groupBy(case, "tool", "grp", "call").agg(F.count_if(~F.col("ok")).alias("missed"))
    closest = per_call.groupBy(case, "tool", "grp").agg(F.min("missed").alias("missed"))
    named = lambda df: df.withColumn("__g", F.coalesce("grp", F.lit(""))).withColumn("__n", F.col("grp").isNull())  # noqa: E731  nulls are equal here
    out = named(many).join(named(closest).drop("grp"), [case, "tool", "__g", "__n"], "left")
    return out.select(case, "tool", "grp", (F.coalesce("missed", "checks") == 0).alias("passed"), F.coalesce("missed", "checks").alias("missed"))


def trajectory_scores(cases: DataFrame, calls: DataFrame, checks: DataFrame, case: str = "case_id") -> DataFrame:
    """case, missing, forbidden, failed_groups, extra_calls, score: 1 if every required tool ran, no forbidden one did and each group of checks is passed by one call.

    ``cases``: case (unique), today, required and forbidden (arrays of tools; null ones are empty). extra_calls counts calls to tools that are not required; it does not lower the score.
    """
    names = calls.groupBy(case).agg(F.collect_set("name").alias("called"))  # names of tools, a few
    none = F.expr("CAST(array() AS array<string>)")
    of = cases.join(names, case, "left").withColumns({c: F.coalesce(c, none) for c in ("called", "required", "forbidden")})
    extra = calls.join(cases.select(case, "required"), case).groupBy(case).agg(F.count_if(~F.array_contains(F.coalesce("required", none), F.col("name"))).alias("extra_calls"))
    failed = checked_groups(calls, checks, cases, case).groupBy(case).agg(F.count_if(~F.col("passed")).alias("failed_groups"))
    out = of.join(failed, case, "left").join(extra, case, "left").fillna(0, ["failed_groups", "extra_calls"])
    out = out.withColumn("missing", F.size(F.array_except("required", "called"))).withColumn("forbidden", F.size(F.array_intersect("forbidden", "called")))
    clean = (F.col("missing") == 0) & (F.col("forbidden") == 0) & (F.col("failed_groups") == 0)
    return out.select(case, "missing", "forbidden", "failed_groups", "extra_calls", clean.cast("double").alias("score"))
