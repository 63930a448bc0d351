"""OSM tags (map<string, string>) and typed metadata values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quadloom.constants import BOOL_FALSE, BOOL_TRUE, INTEGER, NUMERIC, STRING


def has_tag(tags: Column, key: str, value: str) -> Column:
    """A missing tag reads as the empty string."""
    return F.coalesce(tags[key], F.lit("")) == value


def has_any_tag(tags: Column, key: str, *values: str) -> Column:
    """The key exists; with values: its value is one of them."""
    return F.coalesce(tags[key].isin(*values), F.lit(False)) if values else F.coalesce(F.map_contains_key(tags, F.lit(key)), F.lit(False))


def typed(kind: Column | int, text: Column | None = None, number: Column | None = None, whole: Column | None = None) -> Column:
    null = lambda t: F.lit(None).cast(t)
    return F.struct(
        (F.lit(kind) if isinstance(kind, int) else kind).cast("tinyint").alias("vtype"), (null("string") if text is None else text).alias("s"), (null("double") if number is None else number).alias("d"), (null("bigint") if whole is None else whole).alias("i")
    )


def bool_value(v: Column) -> Column:
    return typed(F.when(v, F.lit(BOOL_TRUE)).otherwise(F.lit(BOOL_FALSE)))


def string_value(v: Column) -> Column:
    return typed(STRING, text=v)


def numeric_value(v: Column) -> Column:
    return typed(NUMERIC, number=v.cast("double"))


def integer_value(v: Column) -> Column:
    return typed(INTEGER, whole=v.cast("long"))


def tag_bool(value: Column) -> Column:
    """As the data model has it: "true" gives false, any other value true; null if missing."""
    return value != "true"


def tag_numeric(value: Column) -> Column:
    """The decimal number that the value begins with (blanks before it allowed), else null."""
    found = F.regexp_extract(value, r"^[ \t\n\x0B\f\r]*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)", 1)
    return F.when(found != "", found.try_cast("double"))


def tag_integer(value: Column) -> Column:
    """The whole number that the value begins with, as a double; null if none or out of range."""
    found = F.regexp_extract(value, r"^-?[0-9]+", 0)
    return F.when(found != "", found.try_cast("bigint")).cast("double")


def visible(key: Column) -> Column:
    """Keys that squares show: not `layer`, and none that begin with two underscores."""
    return (key != "layer") & ~key.startswith("__")
