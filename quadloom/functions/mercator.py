"""Web-Mercator between degrees and pixels at zoom 20."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from quadloom.constants import WORLD


def _clamp(v: Column) -> Column:
    # clamped at both ends: polar latitudes would else leave the domain
    return F.greatest(F.least(F.floor(v), F.lit(WORLD - 1)), F.lit(0)).cast("long")


def latlng_to_fixed(lat: Column, lng: Column) -> Column:
    """struct<x, y> in pixels at zoom 20."""
    s = F.sin(F.radians(lat))
    return F.struct(_clamp((lng + 180) / 360 * float(WORLD)).alias("x"), _clamp((0.5 - F.log((1 + s) / (1 - s)) / (4 * F.pi())) * float(WORLD)).alias("y"))


def fixed_to_latlng(x: Column, y: Column) -> Column:
    """struct<lat, lng> in degrees."""
    lat = F.degrees(2 * F.atan(F.exp(F.pi() * (1 - 2 * y / float(WORLD)))) - F.pi() / 2)
    return F.struct(lat.alias("lat"), (x / float(WORLD) * 360 - 180).alias("lng"))
