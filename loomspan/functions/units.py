"""Measurement units to canonical ones; an unknown unit is kept apart, never guessed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spelling, dimension, canonical unit, factor.
UNITS = [
    ("m", "length", "m", 1.0), ("meter", "length", "m", 1.0), ("metre", "length", "m", 1.0), ("km", "length", "m", 1000.0), ("cm", "length", "m", 0.01), ("mm", "length", "m", 0.001),
    ("kg", "mass", "kg", 1.0), ("g", "mass", "kg", 0.001), ("mg", "mass", "kg", 0.000001),
    ("s", "time", "s", 1.0), ("sec", "time", "s", 1.0), ("min", "time", "s", 60.0), ("h", "time", "s", 3600.0), ("day", "time", "s", 86400.0), ("jour", "time", "s", 86400.0), ("year", "time", "s", 31557600.0), ("annee", "time", "s", 31557600.0),
    ("person", "count", "person", 1.0), ("personne", "count", "person", 1.0), ("count", "count", "count", 1.0), ("%", "percentage", "%", 1.0),
]
EARTH_KM = 6371.0088


def canonical(value: Column, unit: Column) -> Column:
    """struct(dimension, unit, value, exact); null for an unknown unit or a temperature below 0 K."""
    spelled = F.lower(F.trim(unit))
    table = F.create_map(*(F.lit(x) for u, d, c, f in UNITS for x in (u, f"{d}|{c}|{f!r}")))
    spec = F.split(F.element_at(table, spelled), r"\|")
    kelvin = F.when(spelled.isin("c", "°c", "celsius"), value + 273.15).when(spelled.isin("f", "°f", "fahrenheit"), (value - 32) * 5 / 9 + 273.15).when(spelled.isin("k", "kelvin"), value)
    row = lambda d, u, v, e: F.struct(d.alias("dimension"), u.alias("unit"), v.alias("value"), e.alias("exact"))
    warm = row(F.lit("temperature"), F.lit("K"), kelvin, ~spelled.isin("f", "°f", "fahrenheit"))
    return F.when(kelvin >= 0, warm).when(kelvin.isNull() & spec.isNotNull(), row(spec[0], spec[1], value * spec[2].cast("double"), F.lit(True)))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.least(F.lit(1.0), F.sqrt(a)))
