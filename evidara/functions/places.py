"""Places on a map."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: how far a place known by its city only is moved, and half the side of a map section, in degrees
CITY_RADIUS, CITY_INNER, SECTION = 0.015, 0.35, 0.008


def unit_hash(seed: Column) -> Column:
    """A steady number from 0 to below 1 in steps of 1/3600: the signed 32-bit hash h * 31 + c of the seed's characters."""
    wrapped = lambda h: F.pmod(h + F.lit(1 << 31), F.lit(1 << 32)) - F.lit(1 << 31)
    codes = F.transform(F.filter(F.split(seed, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    return F.abs(F.aggregate(codes, F.lit(0).cast("long"), lambda h, c: wrapped(h * 31 + c))) % 3600 / 3600


def moved(lat: Column, lon: Column, seed: Column) -> Column:
    """Struct (lat, lon): a steady place within a ring around the point, so that pins of one city don't cover each other."""
    angle = unit_hash(F.concat(seed, F.lit(":angle"))) * 2 * F.pi()
    radius = CITY_RADIUS * (CITY_INNER + (1 - CITY_INNER) * unit_hash(F.concat(seed, F.lit(":radius"))))
    narrow = F.cos(F.radians(lat))
    return F.struct((lat + radius * F.cos(angle)).alias("lat"), (lon + radius * F.sin(angle) / F.when(narrow == 0, 1.0).otherwise(narrow)).alias("lon"))


def section(lat: Column, lon: Column) -> Column:
    """Struct (west, south, east, north) of the map section around a point."""
    return F.struct((lon - SECTION).alias("west"), (lat - SECTION).alias("south"), (lon + SECTION).alias("east"), (lat + SECTION).alias("north"))


def fading(age_days: Column, years: int = 2) -> Column:
    """How far an entry has faded on the map, 0 to 1; fully where its age is not known."""
    return F.when(age_days.isNull(), 1.0).otherwise(F.least(F.greatest(age_days / (365.0 * years), F.lit(0.0)), F.lit(1.0)))
