"""Reference evapotranspiration (FAO-56 Penman-Monteith) as column arithmetic.

Three terms depart from the textbook: air pressure is fixed at 100 kPa, extraterrestrial radiation leaves the solar constant out,
and the saturation pressure divides by tm + 238.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The site, and the albedos of grass and of the planted roofs.
LATITUDE, ELEVATION = 51.353484, 142.0
GRASS_ALBEDO, ROOF_ALBEDO = 0.23, 0.2


def et0_terms(tm: Column, tx: Column, tn: Column, rf: Column, w: Column, gs: Column, day_of_year: Column, albedo: float = GRASS_ALBEDO, latitude: float = LATITUDE, elevation: float = ELEVATION) -> dict[str, Column]:
    """All terms by name; the last one, et0, is in mm a day.

    tm, tx, tn: mean, highest and lowest temperature in °C; rf: relative humidity in %; w: wind in
    km/h; gs: global radiation in J/cm². An albedo outside 0 to 1 or a latitude with polar days is refused.
    """
    if not 0 <= albedo <= 1:
        raise ValueError("albedo is between 0 and 1")
    if abs(latitude) >= 66.5:
        raise ValueError("no sunset or sunrise on some days at this latitude")
    phi = math.radians(latitude)
    es = 0.6108 * F.exp(17.27 * tm / (238 + tm))
    ea = rf / 100 * es
    u2 = w / 3.6
    slope = 4098 * 0.6108 * F.exp(17.27 * tm / (tm + 237.3)) / F.pow(tm + 237.3, 2)
    rs = gs / 8.64 / 1e6 * 86400
    year = 2 * math.pi / 365 * day_of_year
    distance = 1 + 0.033 * F.cos(year)
    declination = 0.409 * F.sin(year - 1.39)
    sunset = F.acos(-math.tan(phi) * F.tan(declination))
    ra = 1440 / math.pi * distance * (sunset * math.sin(phi) * F.sin(declination) + math.cos(phi) * F.cos(declination) * F.sin(sunset))
    rso = (0.75 + 2e-5 * elevation) * ra
    rnl = 4.903e-9 * (F.pow(tx + 273.16, 4) + F.pow(tn + 273.16, 4)) / 2 * (0.34 - 0.14 * F.sqrt(ea)) * (1.35 * rs / rso - 0.35)
    rn = rs * (1 - albedo) - rnl
    gamma = 1.013e-3 * 1e6 * 100 / (0.622 * 2.45e6)
    et0 = (0.408 * slope * rn + 900 / (273 + tm) * gamma * u2 * (es - ea)) / (slope + gamma * (1 + 0.34 * u2))
    return {"es": es, "ea": ea, "u2": u2, "slope": slope, "rs": rs, "ra": ra, "rso": rso, "rnl": rnl, "rn": rn, "gamma": F.lit(gamma), "et0": et0}


def with_et0(weather: DataFrame, day: str = "d", albedo: float = GRASS_ALBEDO) -> DataFrame:
    """``weather`` (day and tm, tx, tn, rf, w, gs) with a column et0; null where an input is."""
    c = F.col
    return weather.withColumn("et0", et0_terms(c("tm"), c("tx"), c("tn"), c("rf"), c("w"), c("gs"), F.dayofyear(day), albedo)["et0"])
