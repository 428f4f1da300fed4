"""Water stores of roofs: a capped bucket with a nonlinear loss, its features, the watering ladder, replays."""

from __future__ import annotations

from operator import itemgetter

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn, SelectedColumn

from isochron.functions.units import theta_to_mm
from isochron.operators.dimensions import DECISION_H, HEAT_C, OUTFLOW_MM, REFILL_H


def bucket_series(steps: DataFrame, keys: list[str], index: str, rain: str, et0: str, initial: Column, residual: Column, capacity: Column) -> DataFrame:
    """The store after each step: keys, index, store, outflow, loss.

    Step 0 starts at ``initial`` and loses nothing; after it the loss is et0 times the filling
    ((store - residual) / (capacity - residual), between 0 and 1). What exceeds the capacity flows
    out; there is no floor at zero. The next store depends on the last in a nonlinear way, so each
    key's steps (a horizon of days or hours, not a record) are folded in order within one row.
    initial, residual and capacity are columns of ``steps``, constant per key, or literals.
    """
    rows = steps.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct(F.col(index).alias("i"), F.col(rain).cast("double").alias("p"), F.col(et0).cast("double").alias("e")))).alias("s"),
        F.first(initial).cast("double").alias("init"), F.first(residual).cast("double").alias("res"), F.first(capacity).cast("double").alias("cap"),
    )
    none = F.lit(None).cast("double")
    state = lambda i, store, out, loss: F.struct(i.alias("i"), store.alias("store"), out.alias("outflow"), loss.alias("loss"))
    first = state(F.lit(None).cast(steps.schema[index].dataType), F.col("init"), none, none)

    def advance(acc: Column, x: Column) -> Column:
        before, start = F.element_at(acc, -1)["store"], F.size(acc) == 1
        filling = F.least(F.greatest((before - F.col("res")) / (F.col("cap") - F.col("res")), F.lit(0.0)), F.lit(1.0))
        loss = F.when(~start, x["e"] * filling)
        level = F.when(start, before).otherwise(before + x["p"] - loss)
        return F.concat(acc, F.array(state(x["i"], F.least(level, F.col("cap")), F.greatest(level - F.col("cap"), F.lit(0.0)), loss)))

    folded = rows.withColumn("f", F.explode(F.slice(F.aggregate("s", F.array(first), advance), 2, F.greatest(F.size("s"), F.lit(1)))))
    return folded.select(*keys, F.col("f.i").alias(index), F.col("f.store").alias("store"), F.col("f.outflow").alias("outflow"), F.col("f.loss").alias("loss"))


class _BucketFold:
    """Table function: the rows of one key come in order, one at a time; what is kept between them is the store alone."""

    def __init__(self) -> None:
        self.store: float | None = None
        self.read: tuple | None = None

    @staticmethod
    def analyze(steps: AnalyzeArgument, keys: AnalyzeArgument, index: AnalyzeArgument, *, rain: AnalyzeArgument, et0: AnalyzeArgument, initial: AnalyzeArgument, residual: AnalyzeArgument, capacity: AnalyzeArgument) -> AnalyzeResult:
        """Asks for the table dealt out by the keys and sorted by index, and only for the columns it reads."""
        if not steps.isTable:
            raise ValueError("the first argument is a table")
        kinds = {f.name: f.dataType for f in steps.dataType.fields}
        by = [k.strip() for k in keys.value.split(",")]
        named = [x.value for x in (index, rain, et0, initial, residual, capacity) if isinstance(x.value, str)]
        if missing := [c for c in (*by, *named) if c not in kinds]:
            raise ValueError(f"no such columns: {missing}")
        out = T.StructType([T.StructField(c, kinds[c]) for c in (*by, index.value)])
        for name in ("store", "outflow", "loss"):
            out = out.add(name, T.DoubleType())
        return AnalyzeResult(out, partitionBy=[PartitioningColumn(f"`{k}`") for k in by], orderBy=[OrderingColumn(f"`{index.value}`")], select=[SelectedColumn(f"`{c}`") for c in dict.fromkeys((*by, *named))])

    def eval(self, step: Row, keys: str, index: str, *, rain: str, et0: str, initial, residual, capacity):
        if self.read is None:  # where the columns are, once a key
            at = {name: k for k, name in enumerate(step.__fields__)}
            number = lambda x: itemgetter(at[x]) if isinstance(x, str) else lambda _, x=float(x): x  # noqa: E731  a column's name or a constant
            self.read = itemgetter(*(at[k.strip()] for k in keys.split(",")), at[index]), *map(number, (rain, et0, initial, residual, capacity))
        of, rain, et0, initial, residual, capacity = self.read
        low, high = residual(step), capacity(step)
        if self.store is None:
            level, loss = initial(step), None
        else:
            loss = et0(step) * min(max((self.store - low) / (high - low), 0.0), 1.0)
            level = self.store + rain(step) - loss
        self.store = min(level, high)
        yield (*of(step), self.store, max(level - high, 0.0), loss)


#: The capped bucket as a table function, for ``spark.udtf.register("bucket_fold", bucket_fold)`` and then, in SQL,
#: ``bucket_fold(TABLE(steps), 'site', 'i', rain => 'rain', et0 => 'et0', initial => 8.0, residual => 2.0, capacity => 'capacity')``: names of columns, or numbers.
bucket_fold = udtf(_BucketFold)


def bucket_scan(steps: DataFrame, keys: list[str], index: str, rain: str, et0: str, initial: Column, residual: Column, capacity: Column) -> DataFrame:
    """As ``bucket_series``, for records of any length: each key's steps go through ``bucket_fold`` in order, in the memory of one step. Rows without a rain or an et0 are refused."""
    number = lambda c, name: c.cast("double").alias(f"__{name}")
    rows = steps.select(*keys, index, number(F.col(rain), "rain"), number(F.col(et0), "et0"), number(initial, "initial"), number(residual, "residual"), number(capacity, "capacity"))
    named = {name: F.lit(f"__{name}") for name in ("rain", "et0", "initial", "residual", "capacity")}
    return bucket_fold(rows.asTable(), F.lit(",".join(keys)), F.lit(index), **named)


def features(steps: DataFrame, keys: list[str], index: str, decision: int = DECISION_H, refill: int = REFILL_H) -> DataFrame:
    """What a decision needs of a run (store, temperature, outflow per step): min_store and max_temp of the first ``decision`` steps, refill_at, has_gaps, is_empty."""
    soon, i = F.col(index) < decision, F.col(index)
    return steps.groupBy(*keys).agg(
        F.min(F.when(soon, F.col("store"))).alias("min_store"), F.max(F.when(soon, F.col("temperature"))).alias("max_temp"),
        F.min(F.when((F.col("outflow") > OUTFLOW_MM) & i.between(1, refill), i)).alias("refill_at"),
        F.max(F.coalesce(F.isnan("store"), F.lit(True)) | F.coalesce(F.isnan("temperature"), F.lit(True))).alias("has_gaps"), (F.count("store") == 0).alias("is_empty"),
    )


def refills(rain: Column, store: Column, capacity: Column) -> Column:
    """Without a run: the rain exceeds what the store can take."""
    return rain - (capacity - store) > OUTFLOW_MM


def threshold(theta_pct: Column, regime: Column, depth_cm: Column) -> Column:
    """A rule's threshold (% by volume) in the unit of a run: regime ``mm`` for a store of that depth, else ``theta``. The ladder is the same in both."""
    return F.when(regime == "mm", theta_to_mm(theta_pct, depth_cm)).otherwise(theta_pct)


def saturated(theta_pct: Column, most: Column | float) -> Column:
    """A water content that a sensor can't report above ``most``; null stays null."""
    return F.when(theta_pct.isNotNull(), F.least(theta_pct, F.lit(most) if isinstance(most, float) else most))


def decision(min_store: Column, max_temp: Column, refill: Column, wilting: Column, dry: Column, is_empty: Column, has_gaps: Column) -> Column:
    """The watering ladder, first match: reasons no_forecast, missing_data, wilting, no_heat, sufficient, refill, dry."""
    return (
        F.when(is_empty, "no_forecast").when(has_gaps, "missing_data").when(min_store <= wilting, "wilting").when(max_temp < HEAT_C, "no_heat")
        .when(min_store > dry, "sufficient").when(refill, "refill").otherwise("dry")
    )


def waters(reason: Column) -> Column:
    """Whether a reason means watering."""
    return reason.isin("wilting", "dry")


def replay(days: DataFrame, key: str, day: str = "d", span: int = 7) -> DataFrame:
    """Every day of a record as the start of a run of ``span`` days: key, start, step, and the day's columns; starts without all days are left out."""
    starts = days.withColumn("__step", F.explode(F.sequence(F.lit(0), F.lit(span - 1)))).withColumn("start", F.date_sub(day, F.col("__step")))
    whole = starts.groupBy(key, "start").agg(F.count("*").alias("__n")).where(F.col("__n") == span).drop("__n")
    return starts.join(whole, [key, "start"], "left_semi").withColumnRenamed("__step", "step")


def flips(decisions: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """Counts of pairs of decisions under two regimes, and whether they differ."""
    return decisions.groupBy(*keys, a, b).agg(F.count("*").alias("n")).withColumn("flip", F.col(a) != F.col(b))


def balance(weather: DataFrame, keys: list[str], day: str, capacity: Column, least: Column, initial: Column, kg: float = 1.0, open_water: bool = False) -> DataFrame:
    """Daily balance of a planted roof without a retention layer: keys, day, store, et, out.

    et = et0 * kg * store / capacity (not throttled for open water); what exceeds the capacity flows out. A
    local stand-in for a remote model: its first day agrees with that, later days can't be compared here.
    """
    rows = weather.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct(F.col(day).alias("d"), F.col("precip").alias("p"), F.col("et0").alias("e")))).alias("s"),
        F.first(capacity).cast("double").alias("cap"), F.first(least).cast("double").alias("low"), F.first(initial).cast("double").alias("init"),
    )
    none = F.lit(None).cast("double")
    state = lambda d, store, et, out: F.struct(d.alias("d"), store.alias("store"), et.alias("et"), out.alias("out"))

    def advance(acc: Column, x: Column) -> Column:
        before = F.element_at(acc, -1)["store"]
        et = x["e"] * kg * (F.lit(1.0) if open_water else before / F.col("cap"))
        level = before + x["p"] - et
        return F.concat(acc, F.array(state(x["d"], F.greatest(F.least(level, F.col("cap")), F.lit(0.0)), et, F.greatest(level - F.col("cap"), F.lit(0.0)))))

    start = F.array(state(F.lit(None).cast("date"), F.col("init"), none, none))
    folded = rows.withColumn("f", F.explode(F.slice(F.aggregate("s", start, advance), 2, F.greatest(F.size("s"), F.lit(1)))))
    return folded.select(*keys, F.col("f.d").alias(day), F.col("f.store").alias("store"), F.col("f.et").alias("et"), F.col("f.out").alias("out"), "low", "cap")


def dry_spell(balanced: DataFrame, keys: list[str], share: float = 0.05) -> DataFrame:
    """min_store and drought: the store came within ``share`` of its range above its least value."""
    return balanced.groupBy(*keys).agg(F.min("store").alias("min_store"), F.bool_or(F.col("store") <= F.col("low") + share * (F.col("cap") - F.col("low"))).alias("drought"))


def what_if(base: DataFrame, forced: DataFrame, keys: list[str], value: str) -> DataFrame:
    """base_value, forced_value, effect, inert: an override without any effect is to be refused."""
    a, b = base.select(*keys, F.col(value).alias("base_value")), forced.select(*keys, F.col(value).alias("forced_value"))
    both = a.join(b, keys)
    return both.withColumn("effect", F.col("forced_value") - F.col("base_value")).withColumn("inert", F.abs("effect") < 1e-9)
