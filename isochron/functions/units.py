"""Unit conversions and roundings as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec


def theta_to_mm(theta_pct: Column, depth_cm: Column | float) -> Column:
    """Water store in mm of a water content in percent by volume and a depth in cm."""
    return theta_pct / 100 * depth_cm * 10


def mm_to_theta(store_mm: Column, depth_cm: Column | float) -> Column:
    """Water content in percent by volume of a store in mm; null for a depth of zero."""
    return store_mm * 100 / F.nullif(F.lit(depth_cm) * 10, F.lit(0.0))


def ms_to_kmh(speed: Column) -> Column:
    return speed * 3.6


def half_hours_to_joule(watts: Column) -> Column:
    """J/cm² of a sum of half-hourly means in W/m²."""
    return watts * 1800 / 1e4


def mean_to_daily_joule(watts: Column) -> Column:
    """J/cm² a day of a daily mean in W/m²."""
    return watts * 8.64


def rounded(x: Column, digits: int = 2) -> Column:
    """Half to even, nulls stay."""
    return F.bround(x, digits)


def exact_sum(x: str | Column, over: WindowSpec | None = None) -> Column:
    """Sum as double that does not depend on the order of the rows: values are added as decimals of 12 places (further ones are rounded).

    Null without values. Values of 1e15 or more, infinities and NaN are added as doubles. ``over``: a window, else an aggregate.
    """
    x = F.col(x) if isinstance(x, str) else x
    total = lambda c: F.sum(c) if over is None else F.sum(c).over(over)
    fits = F.abs(x) < 1e15
    exact = total(F.when(fits, x).cast("decimal(28,12)")).cast("double")
    rest = total(F.when(~fits, x.cast("double")))
    return F.when(rest.isNull(), exact).otherwise(rest + F.coalesce(exact, F.lit(0.0)))


def exact_mean(x: str | Column) -> Column:
    """``exact_sum`` by the number of values; null without values."""
    return F.try_divide(exact_sum(x), F.count(x))


def sum_in_order(x: str | Column, keys: list[str], order: list[str]) -> Column:
    """Sum of the rows of the same ``keys`` as floats that are added one by one in a stated order, on each of these rows (a window).

    The sum of an engine that meets the rows in this order; it may miss the decimal sum in its last digit, which tells at thresholds and
    between totals that nearly tie. A key's rows are sorted in one task, on disk where there are many.
    """
    return F.sum(x).over(W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, W.unboundedFollowing))


def fold(kind: str, x: str | Column) -> Column:
    """The aggregate of a kind of variable: a flux is summed, a state averaged."""
    if kind not in ("flux", "state"):
        raise ValueError(f"neither flux nor state: {kind}")
    return exact_sum(x) if kind == "flux" else exact_mean(x)


def valid_mean(x: str) -> Column:
    """Mean of the readings that are no sentinel: sensors report failures as negative numbers."""
    return F.avg(F.when(F.col(x) >= 0, F.col(x)))
