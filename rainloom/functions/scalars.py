"""Scalar functions of the station analytics, each an expression over columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Mean Earth radius, km.
EARTH_KM = 6371.0088
#: Season of each month.
SEASONS = {12: "DJF", 1: "DJF", 2: "DJF", 3: "MAM", 4: "MAM", 5: "MAM", 6: "JJAS", 7: "JJAS", 8: "JJAS", 9: "JJAS", 10: "ON", 11: "ON"}
MONSOON = (6, 7, 8, 9)
EPS = 1e-7


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    dlat, dlon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    h = F.sin(dlat) * F.sin(dlat) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(dlon) * F.sin(dlon)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


HAVERSINE_SQL = (
    "2 * 6371.0088 * asin(sqrt(least(1.0, pow(sin(radians({lat2} - {lat1}) / 2), 2) + "
    "cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2))))"
)


def hargreaves_pet(tmax: Column, tmin: Column, doy: Column, lat: Column) -> Column:
    """Hargreaves-Samani potential evapotranspiration, mm a day."""
    phi, angle = F.radians(lat), 2 * F.pi() * doy / 365
    distance, tilt = 1 + 0.033 * F.cos(angle), 0.409 * F.sin(angle - 1.39)
    sunset = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), -F.tan(phi) * F.tan(tilt))))
    radiation = 24 * 60 / F.pi() * 0.0820 * distance * (sunset * F.sin(phi) * F.sin(tilt) + F.cos(phi) * F.cos(tilt) * F.sin(sunset))
    spread = F.when((tmax - tmin) > 0, tmax - tmin).when((tmax - tmin).isNotNull(), 0.0)
    pet = 0.0023 * 0.408 * radiation * ((tmax + tmin) / 2 + 17.8) * F.sqrt(spread)
    return F.when(pet.isNotNull(), F.greatest(F.lit(0.0), pet))


def entropy_bits(p: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(EPS)), F.lit(1 - EPS))
    return F.when(p.isNotNull(), -(q * F.log2(q) + (1 - q) * F.log2(1 - q)))


def season(month: Column) -> Column:
    return F.when(month.isin(12, 1, 2), "DJF").when(month.isin(3, 4, 5), "MAM").when(month.isin(*MONSOON), "JJAS").otherwise("ON")


def right_closed(x: Column, edges: list[float], labels: list[str]) -> Column:
    """The label of the interval (low, high] that x is in; null outside."""
    out = F.when(x <= edges[0], F.lit(None))
    for high, label in zip(edges[1:], labels, strict=True):
        out = out.when(x <= high, label)
    return out


def digitized(x: Column, edges: list[float]) -> Column:
    """How many edges are at most x; null for null."""
    count = sum((F.when(x >= e, 1).otherwise(0) for e in edges), F.lit(0))
    return F.when(x.isNotNull(), count)


def regime(spi: Column) -> Column:
    return F.when(spi.isNull(), -1).when(spi <= -1, 0).when(spi >= 1, 2).otherwise(1)


def convert(variable: str, unit: str, x: Column) -> Column:
    """x in the canonical unit of the variable; an unknown pair is an error."""
    kelvin, fahrenheit = (lambda v: v - 273.15), (lambda v: (v - 32) * 5 / 9)
    known = {("precip", "m"): lambda v: v * 1000, ("precip", "kg m-2 s-1"): lambda v: v * 86400}
    known |= {(v, "K"): kelvin for v in ("tmax", "tmin")} | {(v, u): fahrenheit for v in ("tmax", "tmin") for u in ("degF", "F")}
    if (variable, unit) not in known:
        raise ValueError(f"no conversion of {variable} from {unit}")
    return known[variable, unit](x)


def clean_number(x: Column) -> Column:
    """NaN and infinities as null."""
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def logit(p: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(EPS)), F.lit(1 - EPS))
    return F.log(q / (1 - q))


def tempered(p: Column, temperature: float) -> Column:
    return 1 / (1 + F.exp(-logit(p) / temperature))
