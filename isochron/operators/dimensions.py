"""The roof dimension: aliases, columns, plausible bounds, thresholds, bands."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isochron.functions.text import canonical_key

#: Thresholds of the rules (%), least depth of a store, and the plausible range of a water content (%).
RULES = {
    "irrigated_extensive": {"wilting": 5.0, "dry": 10.0, "capacity": 22.0, "residual": 2.5, "valve_min": 30},
    "non_irrigated_extensive": {"wilting": 4.0, "dry": 10.0, "capacity": 22.0, "residual": 2.5, "valve_min": 30},
    "semi_intensive": {"wilting": 10.0, "dry": 16.0, "capacity": 22.0, "residual": 2.5, "valve_min": 31},
}
SWC_BOUNDS = {"gravel": (0.0, 20.0), "irrigated_extensive": (1.0, 60.0), "non_irrigated_extensive": (0.5, 60.0), "semi_intensive": (1.0, 60.0), "wetland": (2.0, 100.0)}
HEAT_C, OUTFLOW_MM, DECISION_H, REFILL_H = 24.0, 0.01, 48, 168


def rules(spark: SparkSession) -> DataFrame:
    """roof, wilting, dry, capacity, residual, valve_min."""
    return spark.createDataFrame([(k, *v.values()) for k, v in RULES.items()], "roof string, wilting double, dry double, capacity double, residual double, valve_min int")


def resolve_aliases(rows: DataFrame, name: str, dim: DataFrame, key: str = "key", aliases: str = "aliases") -> DataFrame:
    """``rows`` with the key whose aliases (or itself) have their ``name``, whatever its case; null if none has."""
    long = dim.select(F.col(key).alias("resolved"), F.explode(F.array_append(aliases, F.col(key))).alias("__a"))
    long = long.groupBy(canonical_key("__a").alias("__a")).agg(F.min("resolved").alias("resolved"))
    return rows.withColumn("__a", canonical_key(name)).join(long, "__a", "left").drop("__a")


def within_bounds(rows: DataFrame, bounds: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``rows`` with plausible: the value lies in its (low, high); true where no bounds are known, null for a null value."""
    joined = rows.join(bounds, keys, "left")
    return joined.withColumn("plausible", F.when(F.col(value).isNotNull(), F.coalesce(F.col(value).between(F.col("low"), F.col("high")), F.lit(True)))).drop("low", "high")


def bands(rules: DataFrame, bounds: DataFrame, key: str = "roof") -> DataFrame:
    """Low, normal and high bands of each key, cut at dry and capacity; neighbours share their end."""
    both = rules.join(bounds, key)
    band = F.explode(F.array(*(F.struct(F.lit(n).alias("band"), F.col(a).alias("from"), F.col(b).alias("to")) for n, a, b in (("low", "low", "dry"), ("normal", "dry", "capacity"), ("high", "capacity", "high")))))
    return both.select(key, band.alias("b")).select(key, "b.band", F.col("b.from").alias("lower"), F.col("b.to").alias("upper"))


#: Parameters of the roofs' water balance (depth in cm, store in mm); all have no retention layer and a crop factor of 1.
PRESETS = {
    "irrigated_extensive": (7.0, 3.3, 22.8, 0.2, False),
    "non_irrigated_extensive": (7.0, 0.9, 16.0, 0.2, False),
    "semi_intensive": (15.0, 6.3, 45.6, 0.2, False),
    "wetland": (1.7, 1.3, 90.0, 0.06, True),
}


def with_preset(rows: DataFrame, roof: str, albedo: str | None = None) -> DataFrame:
    """``rows`` with the parameters of their roof: depth_cm, store_min, store_max, albedo, open_water, retention, kg; null for roofs without a preset. A value in the column ``albedo`` goes before the preset's."""
    names = ("depth_cm", "store_min", "store_max", "__albedo", "open_water")
    of = F.create_map(*(x for k, v in PRESETS.items() for x in (F.lit(k), F.struct(*(F.lit(a).alias(n) for n, a in zip(names, v, strict=True))))))
    out = rows.withColumn("__p", F.try_element_at(of, F.col(roof)))
    own = F.col(albedo) if albedo else F.lit(None).cast("double")
    known = F.col("__p").isNotNull()
    return out.select(
        *(c for c in rows.columns if c != "albedo"), *(F.col(f"__p.{n}").alias(n) for n in names if n != "__albedo"), F.when(known, F.coalesce(own, "__p.__albedo")).alias("albedo"), F.when(known, F.lit(0.0)).alias("retention"), F.when(known, F.lit(1.0)).alias("kg"),
    )


def column_value(rows: DataFrame, name: str, out: str = "value") -> DataFrame:
    """``rows`` with the value of the column that the text column ``name`` names (resolved row by row, as a dimension gives it); null for a name that is no column. Only numeric columns can be named."""
    numeric = [f.name for f in rows.schema.fields if f.dataType.simpleString() in ("double", "float", "int", "bigint", "smallint", "tinyint")]
    value = F.lit(None).cast("double")
    for c in numeric:
        value = F.when(F.col(name) == c, F.col(c).cast("double")).otherwise(value)
    return rows.withColumn(out, value)


def json_safe(rows: DataFrame, out: str = "row") -> DataFrame:
    """Each row as one JSON text with its columns in order; what JSON has no form for (days, instants, decimals, binary) is its text, numbers that are none are null, and nulls stay."""
    plain = ("string", "int", "bigint", "smallint", "tinyint", "boolean", "array", "struct", "map")
    cells = []
    for name, kind in rows.dtypes:
        c = F.col(f"`{name}`")
        if kind in ("double", "float"):
            c = F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)
        elif not kind.startswith(plain):
            c = F.hex(c) if kind == "binary" else c.cast("string")
        cells.append(c.alias(name))
    return rows.select(F.to_json(F.struct(*cells), {"ignoreNullFields": "false"}).alias(out))
