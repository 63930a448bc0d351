"""What map styles ask of the layers: filters by zoom and tags, widths by zoom, the order of symbols."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def not_in(value: Column, *values: str) -> Column:
    """A missing value is in no list."""
    return ~F.coalesce(value.isin(*values), F.lit(False))


def shown_cities(cities: DataFrame, zoom: int, least: float = 10000) -> DataFrame:
    """Cities and towns: below zoom 10 only those above `least` inhabitants (none told: 0)."""
    return cities.where(F.lit(zoom > 10) | (F.coalesce("population", F.lit(0.0)) > least))


def interpolate(zoom: Column, stops: tuple[tuple[float, float], ...]) -> Column:
    """Piecewise linear, flat beyond the ends."""
    out = F.lit(float(stops[-1][1]))
    for (z0, v0), (z1, v1) in reversed(list(zip(stops, stops[1:]))):
        out = F.when(zoom < z1, F.lit(float(v0)) + (zoom - z0) * ((v1 - v0) / (z1 - z0))).otherwise(out)
    return F.when(zoom < stops[0][0], F.lit(float(stops[0][1]))).otherwise(out)


#: Line width in pixels by zoom, per class of road; each class's base width scales it.
WIDTH_STOPS = ((5, 1.0), (9, 2.0), (12, 4.0), (14, 8.0), (20, 24.0))
BASE_WIDTH = {"motorway": 1.0, "trunk": 1.0, "primary": 0.75, "secondary": 0.75, "tertiary": 0.5, "residential": 0.25}


def road_width(highway: Column, zoom: Column) -> Column:
    base = F.lit(0.125)
    for kind, width in BASE_WIDTH.items():
        base = F.when(highway == kind, F.lit(width)).otherwise(base)
    return base * interpolate(zoom, WIDTH_STOPS)


def symbol_order(rows: DataFrame, population: str = "population", key: str = "id") -> Column:
    """Rank of symbols: the most inhabitants first."""
    from pyspark.sql import Window

    return F.row_number().over(Window.orderBy(F.coalesce(population, F.lit(0.0)).desc(), key))
