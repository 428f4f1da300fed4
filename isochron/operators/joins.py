"""Joins over readings: as-of lookups, overlays, pairings, alignments."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from isochron.operators.ranks import numbered
from isochron.working import cut


def latest_before(readings: DataFrame, bound: dt.datetime, keys: list[str] | None = None, ts: str = "ts", value: str = "value", cutoff: dt.datetime | None = None, stale_days: int = 7) -> DataFrame:
    """The last reading at or before ``bound``, per ``keys``: value, ts, age_hours, stale.

    ``cutoff``: readings from then on are of a failed sensor and don't count. Null values don't count.
    One aggregation with map-side combine; nothing is sorted. Groups without a reading have no row.
    """
    found = readings.where((F.col(ts) <= F.lit(bound).cast("timestamp_ntz")) & F.col(value).isNotNull())
    if cutoff is not None:
        found = found.where(F.col(ts) < F.lit(cutoff).cast("timestamp_ntz"))
    last = found.groupBy(*(keys or [])).agg(F.max(F.struct(F.col(ts), F.col(value))).alias("last")).where("last IS NOT NULL")
    age = F.timestamp_diff("SECOND", F.col(f"last.{ts}"), F.lit(bound).cast("timestamp_ntz")) / 3600
    return last.select(*(keys or []), F.col(f"last.{value}").alias(value), F.col(f"last.{ts}").alias(ts), age.alias("age_hours"), (age > 24 * stale_days).alias("stale"))


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], on: str = "ts", value: str = "value", out: str = "asof_value", allow_equal: bool = True) -> DataFrame:
    """Each row of ``left`` with the last non-null ``value`` of ``right`` at or before its ``on``, by ``keys``.

    The sides are unioned and a window carries the last value forward: one shuffle by the keys, one
    sort, no pairs. ``allow_equal=False`` takes strictly earlier ones. Left columns stay; rows without a match get null.
    """
    if out in left.columns:
        raise ValueError(f"{out} is a column of the left side")
    first, second = (0, 1) if allow_equal else (1, 0)
    a = left.select(*left.columns, F.lit(None).cast(right.schema[value].dataType).alias("__value"), F.lit(second).alias("__order"), F.lit(True).alias("__left"))
    b = right.where(F.col(value).isNotNull()).select(
        *(F.col(c) if c in keys or c == on else F.lit(None).cast(left.schema[c].dataType).alias(c) for c in left.columns),
        F.col(value).alias("__value"), F.lit(first).alias("__order"), F.lit(False).alias("__left"),
    )
    w = W.partitionBy(*keys).orderBy(on, "__order", "__value").rowsBetween(W.unboundedPreceding, W.currentRow)
    both = a.unionByName(b).withColumn(out, F.last("__value", ignorenulls=True).over(w))
    return both.where("__left").select(*left.columns, out)


def overlay(base: DataFrame, forcings: DataFrame, day: str, fields: list[str]) -> DataFrame:
    """``base`` with ``forcings`` (day, field, value) in place of what it had; one row a day in ``base``."""
    wide = forcings.groupBy(F.col(day).alias("__day")).pivot("field", fields).agg(F.max("value"))
    wide = wide.select("__day", *(F.col(f).alias(f"__{f}") for f in fields))
    joined = base.join(wide, base[day] == wide["__day"], "left")
    return joined.select(*(F.coalesce(f"__{c}", c).alias(c) if c in fields else F.col(c) for c in base.columns))


def unmatched_forcings(base: DataFrame, forcings: DataFrame, day: str) -> DataFrame:
    """Forcings of days that ``base`` doesn't have: an error of the caller, to be shown."""
    return forcings.join(base.select(day).distinct(), day, "left_anti")


def paired_mean_difference(rows: DataFrame, a: str, b: str, keys: list[str] | None = None) -> DataFrame:
    """Mean of a - b over rows that have both (not the difference of the means): mean_diff, pairs."""
    both = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    return both.groupBy(*(keys or [])).agg(F.avg(F.col(a) - F.col(b)).alias("mean_diff"), F.count("*").alias("pairs"))


def align(series: DataFrame, names: list[str], at: str = "at", name: str = "series", value: str = "value") -> DataFrame:
    """Long series side by side: one row per instant that any of ``names`` has, null where one has none."""
    return series.where(F.col(name).isin(names)).groupBy(at).pivot(name, names).agg(F.first(value))


def difference(aligned: DataFrame, left: str, right: str) -> DataFrame:
    """left - right at instants that have both."""
    return aligned.where(F.col(left).isNotNull() & F.col(right).isNotNull()).withColumn("diff", F.col(left) - F.col(right))


def before_after(rows: DataFrame, keys: list[str], phase: str, value: str, before: str, after: str) -> DataFrame:
    """Items that have both phases: keys, before, after. One aggregation, no self-join; of several rows of a phase the largest counts."""
    of = lambda p: F.max(F.when(F.col(phase) == p, F.col(value)))
    both = rows.where(F.col(phase).isin(before, after)).groupBy(*keys).agg(of(before).alias("before"), of(after).alias("after"))
    return both.where(F.col("before").isNotNull() & F.col("after").isNotNull())


def forcing_errors(forcings: DataFrame, fields: list[str], start: dt.date, end: dt.date) -> DataFrame:
    """Forcings (field, day, value, all texts) with a reason to refuse them: unknown_field, no_day, outside_window or no_number; those without one are left out."""
    day = F.col("day").try_cast("date")
    reason = F.when(~F.coalesce(F.col("field").isin(fields), F.lit(False)), "unknown_field").when(day.isNull(), "no_day").when(~day.between(F.lit(start), F.lit(end)), "outside_window")
    number = F.col("value").try_cast("double")
    reason = reason.when(number.isNull() | F.isnan(number), "no_number")
    return forcings.withColumn("reason", reason).where(F.col("reason").isNotNull())


def interval_join(points: DataFrame, intervals: DataFrame, day: str, start: str, end: str) -> DataFrame:
    """Points (a day) with the intervals that hold them, both ends included: intervals are unrolled to days, then joined by equality."""
    unrolled = intervals.withColumn("__day", F.explode(F.sequence(start, end)))
    return points.join(unrolled, points[day] == unrolled["__day"]).drop("__day")


def paired_arms(outcomes: DataFrame, left: str, right: str, excluded: DataFrame | None = None, case: str = "case_id") -> DataFrame:
    """Cases that both arms have, less the excluded ones: case, left_value, right_value. ``outcomes``: arm, case, value."""
    a = outcomes.where(F.col("arm") == left).groupBy(case).agg(F.avg("value").alias("left_value"))
    b = outcomes.where(F.col("arm") == right).groupBy(case).agg(F.avg("value").alias("right_value"))
    both = a.join(b, case)
    return both if excluded is None else both.join(excluded.select(case).distinct(), case, "left_anti")


def lookup_by_any(rows: DataFrame, dim: DataFrame, key: str, keys: list[str], value: str) -> DataFrame:
    """``rows`` with ``value`` of the ``dim`` row that has their key in any of the columns ``keys``; the smallest one where several do."""
    long = dim.select(F.explode(F.array(*keys)).alias("__key"), value).where("__key IS NOT NULL").groupBy("__key").agg(F.min(value).alias(value))
    return rows.join(long, rows[key] == long["__key"], "left").drop("__key")


def positional_join(a: DataFrame, b: DataFrame, order_a: list[str], order_b: list[str]) -> DataFrame:
    """Rows of equal rank side by side; the longer side's rest has nulls. Each side is range-sorted and numbered over all its tasks, then joined by number."""
    return numbered(a, order_a, "__n").join(numbered(b, order_b, "__n"), "__n", "full_outer").drop("__n")


#: A word, or a number with its points: where a token of a text ends, a literal that ends there ends as well.
_TOKEN = r"[\p{L}\p{N}]++(?:(?<=\p{N})[.,]\p{N}++)*+"


#: Literals are told apart by so many classes of their first tokens.
_CLASSES = 1 << 16
#: So many literals, counted first, are sent to all tasks; more are shuffled.
_FEW = 200_000


def _parts(c: Column) -> Column:
    """What lies before, between and after the tokens, and the tokens, by turns: an odd number of texts. NUL marks the cuts and is written in another way."""
    marked = F.regexp_replace(F.replace(F.replace(c, F.lit("\x01"), F.lit("\x01\x03")), F.lit("\x00"), F.lit("\x01\x02")), _TOKEN, "\x00$0\x00")
    return F.split(marked, "\x00")


def _class(token: Column) -> Column:
    return F.xxhash64(token).bitwiseAND(_CLASSES - 1).cast("int")


def _run(parts: Column, i: Column, n: Column | int) -> Column:
    """``n`` tokens from number ``i`` on (from 1), with what lies between them."""
    return F.array_join(F.slice(parts, 2 * i, 2 * (n if isinstance(n, Column) else F.lit(n)) - 1), "")


def _alone(parts: Column, i: Column, n: Column | int) -> Column:
    """Whether no word or number goes on before or after ``n`` tokens from number ``i`` on."""
    before, after = F.get(parts, 2 * i - 2), F.get(parts, 2 * (i + n) - 2)
    point = lambda c: c.isin(".", ",")
    starts = (i == 1) | ((before != "") & ~(point(before) & F.get(parts, 2 * i - 3).rlike(r"\p{N}\z")))
    ends = (2 * (i + n) - 1 == F.size(parts)) | ((after != "") & ~(point(after) & F.get(parts, 2 * (i + n) - 1).rlike(r"\A\p{N}")))
    return starts & ends


def _holding(rows: DataFrame, wanted: DataFrame, text: str, keep: list[str], salts: int) -> DataFrame:
    """__l and ``keep`` of the rows whose ``text`` holds a literal of ``wanted`` (__l, __first, __n, __core, __signs; written)."""
    kinds = [tuple(r) for r in wanted.select("__n", "__signs").distinct().sort("__n", "__signs").collect()]  # numbers of tokens, not literals
    if not kinds:
        return rows.select(F.lit(None).cast("string").alias("__l"), *keep).limit(0)
    signed = any(signs for _, signs in kinds)
    bits = {k: 1 << min(x, 62) for x, k in enumerate(kinds)}
    bit = F.coalesce(*(F.when((F.col("__n") == n) & (F.col("__signs") == signs), F.lit(b).cast("bigint")) for (n, signs), b in bits.items()))
    masks = [0] * _CLASSES
    for k, mask in wanted.groupBy(_class(F.col("__first"))).agg(F.bit_or(bit)).collect():  # at most _CLASSES rows
        masks[k] = mask
    mask = F.split(F.lit(",".join(map(str, masks))), ",").cast("array<bigint>")  # folded to a literal

    p = F.col("__p")
    cut_ = rows.select(*keep, text, _parts(F.col(text)).alias("__p"))
    numbers = F.when(F.size(p) > 1, F.sequence(F.lit(1), F.floor(F.size(p) / 2).cast("int")))
    starts = F.filter(F.transform(numbers, lambda i: F.struct(i.alias("i"), F.get(mask, _class(F.get(p, 2 * i - 1))).alias("m"))), lambda x: x["m"] != 0)

    def runs(n: int, signs: bool) -> Column:
        whole = lambda x: (x["m"].bitwiseAND(F.lit(bits[n, signs]).cast("bigint")) != 0) & (2 * (x["i"] + n) - 1 <= F.size(p))
        found = F.filter("__s", lambda x: whole(x) if signs else whole(x) & _alone(p, x["i"], n))
        return F.array_distinct(F.transform(found, lambda x: _run(p, x["i"], n)))

    # a text that has a token twice has its runs made distinct within its row; of others each token is a row, and its runs are made where it is some literal's first
    firsts = wanted.select("__first", "__n", "__signs").distinct()
    few = wanted.count() <= _FEW
    twice = F.size(F.array_distinct("__words")) < F.size("__words") if few else F.lit(True)
    cut_ = cut_.select(*keep, text, "__p", F.filter(p, lambda x, i: i % 2 == 1).alias("__words"))
    cut_ = cut_.select("*", twice.alias("__twice")).withColumn("__s", F.when(F.col("__twice"), starts))
    own = F.flatten(F.array(*(F.transform(runs(n, signs), lambda core: F.concat(F.lit("1" if signs else "0"), core)) for n, signs in kinds)))  # noqa: B023
    # outer: else a test of the array for emptiness is added, which makes it twice; a null text has no row
    cored = cut_.select(*keep, text, "__p", "__twice", F.posexplode_outer(F.when(F.col("__twice"), own).otherwise(F.col("__words"))).alias("__i", "__r")).where("__r IS NOT NULL")
    core, signs = F.substring("__r", 2, 2**31 - 1), F.startswith("__r", F.lit("1"))
    if few:
        i, n = F.col("__i") + 1, F.col("__n")
        cored = cored.withColumn("__first", F.when(~F.col("__twice"), F.col("__r"))).join(F.broadcast(firsts), "__first", "left").where("__twice OR __n IS NOT NULL")
        whole = (2 * (i + n) - 1 <= F.size(p)) & (F.col("__signs") | _alone(p, i, n))
        core, signs = F.when(F.col("__twice"), core).when(whole, _run(p, i, n)), F.when(F.col("__twice"), signs).otherwise(F.col("__signs"))
    # no literal's run is empty; a run that may be null would be made twice, to test it before the join. Only literals with signs are looked for in the text again
    core, signs = F.coalesce(core, F.lit("")), F.coalesce(signs, F.lit(False))
    cored = cored.select(*keep, core.alias("__core"), signs.alias("__signs"), F.when(signs, F.col(text)).alias("__text") if signed else F.lit(None).cast("string").alias("__text"))
    key, own = ["__core", "__signs"], wanted.select("__l", "__core", "__signs")
    if few:
        met = cored.join(F.broadcast(own), key)
    else:
        spread = own.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        met = cored.withColumn("__salt", F.pmod(F.xxhash64("__core", *keep), F.lit(salts)).cast("int")).join(spread, [*key, "__salt"])
    quoted = F.concat(F.lit(r"(?<![\p{L}\p{N}])(?<!\p{N}[.,])\Q"), F.replace(F.col("__l"), F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E(?![\p{L}\p{N}])(?![.,]\p{N})"))
    return met.where(~F.col("__signs") | F.regexp_like("__text", quoted)).select("__l", *keep)


def leaks(literals: DataFrame, texts: DataFrame, seed_texts: DataFrame, literal: str = "literal", text: str = "text", salts: int = 16) -> DataFrame:
    """literal, text_id: texts that hold a gold literal (words, numbers, dates, signs) which no seed text holds.

    A literal is held where no word or number goes on at either end: "17" not in "17.5", "small ring" not in "small rings".
    A literal without letters and digits is held by no text. Texts are cut into tokens once, where they are read. Where a token's class is that of the first
    one of some literals, runs of as many tokens as those have are joined with the literals by equality: with all of them in each task if
    they were counted to be few, else dealt out by run and a hash of the text's id. Runs that stand alone are those of plain literals; only a literal that starts
    or ends with signs is looked for in the text, character by character.
    """
    p = F.col("__p")
    known = literals.select(F.col(literal).alias("__l")).where("__l IS NOT NULL").distinct().select("__l", _parts(F.col("__l")).alias("__p")).where(F.size("__p") > 1)
    n = F.floor(F.size(p) / 2).cast("int")
    signs = (F.get(p, F.lit(0)) != "") | (F.element_at(p, -1) != "")
    wanted = cut(known.select("__l", F.get(p, F.lit(1)).alias("__first"), n.alias("__n"), _run(p, F.lit(1), n).alias("__core"), signs.alias("__signs")))
    gold = cut(wanted.join(_holding(seed_texts, wanted, text, [], salts).distinct(), "__l", "left_anti"))
    return _holding(texts, gold, text, ["text_id"], salts).select(F.col("__l").alias(literal), "text_id")


def nearest_text(queries: DataFrame, known: DataFrame, key: str = "key", block: str = "block") -> DataFrame:
    """For each query the known text of the same block with the smallest edit distance: key, best, similarity (1 - distance / longer length)."""
    longer = F.greatest(F.length(key), F.length("__k"))
    pairs = queries.select(key, block).join(known.select(F.col(key).alias("__k"), block), block)
    scored = pairs.withColumn("s", 1 - F.levenshtein(F.col(key), F.col("__k")) / longer)
    return scored.groupBy(key, block).agg(F.max_by("__k", F.struct("s", "__k")).alias("best"), F.max("s").alias("similarity"))
