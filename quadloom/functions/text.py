"""Strings at the edges: tile URLs, percent encoding, file names and readable numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: As the server has it: the dot before the suffix is any character.
SERVER_URL = r"^/(\d+)/(\d+)/(\d+).mvt$"
LIBRARY_URL = r"^.*/(\d+)/(\d+)/(\d+).mvt$"


def parse_tile_url(url: Column, pattern: str = SERVER_URL) -> Column:
    """struct<z, x, y>, or null where the URL isn't one of a tile."""
    part = lambda i: F.regexp_extract(url, pattern, i).try_cast("bigint")
    return F.when(url.rlike(pattern), F.struct(part(1).alias("z"), part(2).alias("x"), part(3).alias("y")))


def url_decode(url: Column) -> Column:
    """%XX and + decoded; null where an escape is cut short."""
    return F.try_url_decode(url)


def pack_file_name(name: Column) -> Column:
    return F.when(name.endswith(".mdb"), F.regexp_replace(name, r"\.mdb$", ".pck")).otherwise(F.concat(name, F.lit(".pck")))


def _scaled(v: Column, base: float, units: list[str], digits: int, plain: str) -> Column:
    """The number in the largest unit that leaves it below `base`, right-aligned; units from the largest."""
    d = v.cast("double")
    out = F.concat(F.format_string("%" + plain, d), F.lit(units[-1]))
    for k in range(1, len(units)):
        scaled = F.concat(F.format_string(f"%7.{digits}f", d / base**k), F.lit(units[-1 - k]))
        out = F.when(d >= base**k, scaled).otherwise(out)
    return out


def readable_bytes(v: Column) -> Column:
    return _scaled(v, 1024.0, ["GB", "MB", "KB", "B "], 2, "7.2f")


def readable_ns(v: Column) -> Column:
    return _scaled(v, 1000.0, ["s ", "ms", "\u00b5s", "ns"], 3, "7.3f")


def http_status(method: Column, url: Column, accepts_deflate: Column, size: Column) -> Column:
    """Status of a request: size is the tile's bytes, null or 0 if there is none."""
    return (
        F.when(method == "OPTIONS", 204)
        .when(~method.isin("GET", "HEAD"), 405)
        .when(parse_tile_url(url).isNull(), 404)
        .when(~accepts_deflate, 501)
        .when(F.coalesce(size, F.lit(0)) == 0, 204)
        .otherwise(200)
        .cast("int")
    )
