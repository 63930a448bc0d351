"""Classification profiles: ordered rules over tags, compiled to one expression per output.

A rule says when it holds, which layer and lowest zoom a feature gets, and which metadata. The
first rule that holds decides. compile() turns a profile into `when` chains that Catalyst sees;
no function runs per row. A rule without a zoom leaves the feature unapproved.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadloom.constants import DEFAULT_MAX_Z
from quadloom.functions.tags import bool_value, has_any_tag, has_tag, numeric_value, string_value, tag_bool, tag_integer, tag_numeric

Condition = Callable[[Column], Column]


def any_of(key: str, *values: str) -> Condition:
    return lambda tags: has_any_tag(tags, key, *values)


def is_(key: str, value: str) -> Condition:
    return lambda tags: has_tag(tags, key, value)


def either(*conditions: Condition) -> Condition:
    return lambda tags: reduce(lambda a, b: a | b, [c(tags) for c in conditions])


def both(*conditions: Condition) -> Condition:
    return lambda tags: reduce(lambda a, b: a & b, [c(tags) for c in conditions])


@dataclass(frozen=True)
class Meta:
    """One metadata entry: a constant, or a tag read as bool, string, numeric or integer."""

    key: str
    kind: str = "string"
    const: str | None = None

    def value(self, tags: Column) -> Column:
        tag = tags[self.key]
        if self.const is not None:
            return string_value(F.lit(self.const))
        made = {"bool": bool_value(tag_bool(tag)), "string": string_value(tag), "numeric": numeric_value(tag_numeric(tag)), "integer": numeric_value(tag_integer(tag))}[self.kind]
        there = {"numeric": tag_numeric(tag), "integer": tag_integer(tag)}.get(self.kind, tag)
        return F.when(there.isNotNull(), made)


@dataclass(frozen=True)
class Rule:
    when: Condition
    layer: str | None
    zoom: int | None = None
    #: (zoom, area limit) pairs in order, the limit -1 for any area
    by_area: tuple[tuple[int, int], ...] = ()
    meta: tuple[Meta, ...] = ()
    max_zoom: int = DEFAULT_MAX_Z


def min_by_area(area: Column, pairs: tuple[tuple[int, int], ...]) -> Column:
    """The zoom of the first pair whose limit is -1 or above the area; null if none is."""
    out = F.lit(None).cast("int")
    for zoom, limit in reversed(pairs):
        out = F.lit(zoom) if limit == -1 else F.when(area < limit, F.lit(zoom)).otherwise(out)
    return out


@dataclass(frozen=True)
class Profile:
    node: tuple[Rule, ...] = ()
    way: tuple[Rule, ...] = ()
    area: tuple[Rule, ...] = field(default=())


def _by_rule(rules: tuple[Rule, ...], number: Column, value: Callable[[Rule], Column], otherwise: Column) -> Column:
    """The value that the row's rule has."""
    out = otherwise
    for i, rule in reversed(list(enumerate(rules))):
        out = F.when(number == i, value(rule)).otherwise(out)
    return out


def classify(features: DataFrame, rules: tuple[Rule, ...], tags: str = "tags", area: str | None = None) -> DataFrame:
    """features that a rule approves, with layer, min_z, max_z and meta (array of key and typed value).

    The first rule that holds is found once per row, as a number; layer, zoom and metadata
    follow from it. They pass through a generator, so that the filter on the zoom isn't pushed
    below it with a copy of every rule. An approved feature without a layer is an error.
    """
    t = F.col(tags)
    none = F.lit(None)
    kind = "array<struct<key:string,value:struct<vtype:tinyint,s:string,d:double,i:bigint>>>"
    first = none.cast("int")
    for i, rule in reversed(list(enumerate(rules))):
        first = F.when(rule.when(t), F.lit(i)).otherwise(first)

    def entries(rule: Rule) -> Column:
        if not rule.meta:
            return F.array().cast(kind)
        made = F.array(*[F.struct(F.lit(m.key).alias("key"), m.value(t).alias("value")) for m in sorted(rule.meta, key=lambda m: m.key)])
        return F.filter(made, lambda m: m["value"].isNotNull()).cast(kind)

    def outputs(n: Column) -> Column:
        zoom = _by_rule(rules, n, lambda r: min_by_area(F.col(area), r.by_area) if r.by_area else F.lit(r.zoom).cast("int"), none.cast("int"))
        return F.struct(
            _by_rule(rules, n, lambda r: F.lit(r.layer), none.cast("string")).alias("layer"), zoom.alias("min_z"),
            _by_rule(rules, n, lambda r: F.lit(r.max_zoom), none.cast("int")).alias("max_z"), _by_rule(rules, n, entries, none.cast(kind)).alias("meta"),
        )

    made = features.withColumn("_made", F.explode(F.transform(F.array(first), outputs))).where(F.col("_made.min_z").isNotNull())
    rest = [c for c in features.columns if c not in ("layer", "min_z", "max_z", "meta")]
    layer = F.when(F.coalesce(F.col("_made.layer"), F.lit("")) == "", F.raise_error(F.lit("approved feature without a layer"))).otherwise(F.col("_made.layer"))
    return made.select(*rest, layer.alias("layer"), "_made.min_z", "_made.max_z", "_made.meta")


# -- the bundled profiles -----------------------------------------------------------------

_PLACE = (Meta("place"), Meta("name"), Meta("population", "integer"))
_NAMED = (Meta("highway"), Meta("name"))
_NAMED_REF = (*_NAMED, Meta("ref"))
_SMALL_PATHS = ("path", "cycleway", "steps", "track", "footway")
_STREETS = ("service", "unclassified", "tertiary_link", "secondary_link", "primary_link", "living_street", "residential")
_MAJOR = ("aeroway", "tertiary", "secondary", "primary", "trunk_link", "motorway_link")
_WORKING_RAIL = either(any_of("usage", "tourism", "test", "military", "industrial"), any_of("service", "spur", "yard"), is_("railway", "miniature"), is_("railway:preserved", "yes"))


def _roads(streets: tuple[str, ...], paths: tuple[str, ...], path_zoom: int) -> tuple[Rule, ...]:
    return (
        Rule(any_of("highway", "trunk", "motorway"), "road", 5, meta=_NAMED_REF),
        Rule(any_of("highway", *_MAJOR), "road", 9, meta=_NAMED_REF),
        Rule(any_of("highway", *streets), "road", 12, meta=_NAMED),
        *((Rule(any_of("highway", *paths), "road", path_zoom, meta=_NAMED),) if paths else ()),
        Rule(any_of("highway"), "road", None, meta=_NAMED),
    )


def _rails(gate: tuple[str, ...], secondary: tuple[str, ...]) -> tuple[Rule, ...]:
    open_ = any_of("railway", *gate)
    kind = lambda name: (Meta("rail", const=name),)
    return (
        # the gate lets no disused track through: this rule never holds, and is kept as the profile states it
        Rule(both(open_, any_of("railway", "abandoned", "disused")), "rail", 14, meta=kind("old")),
        Rule(both(open_, _WORKING_RAIL), "rail", 14, meta=kind("detail")),
        Rule(both(open_, any_of("railway", *secondary)), "rail", 10, meta=kind("secondary")),
        Rule(open_, "rail", 5, meta=kind("primary")),
    )


_WATERWAYS = (
    Rule(any_of("waterway", "canal", "river"), "waterway", 8),
    Rule(is_("waterway", "stream"), "waterway", 13),
    Rule(any_of("waterway", "drain", "ditch"), "waterway", 15),
    Rule(any_of("waterway"), "waterway", None),
)

_D = ((14, 10**8), (10, 10**10), (8, -1))


def _land(const: str) -> tuple[Meta, ...]:
    return (Meta("landuse", const=const),)


_AREA = {
    1: Rule(any_of("building"), "building", by_area=((14, 10**8), (12, 10**10), (10, -1))),
    2: Rule(any_of("landuse", "commercial", "industrial", "retail", "residential"), "landuse", by_area=_D, meta=(Meta("landuse"),)),
    3: Rule(any_of("landuse", "railway", "farmyard", "quarry"), "landuse", by_area=_D, meta=_land("industrial")),
    4: Rule(
        either(is_("leisure", "sports_centre"), any_of("amenity", "university", "place_of_worship", "school", "kindergarten", "fire_station", "police", "hospital")),
        "landuse", by_area=_D, meta=_land("complex"),
    ),
    5: Rule(either(is_("landuse", "forest"), any_of("natural", "scrub", "oarchard", "wood")), "landuse", by_area=_D, meta=_land("nature_heavy")),
    6: Rule(either(is_("natural", "grassland"), any_of("landuse", "grass", "meadow", "plant_nursery", "vineyard", "farmland")), "landuse", by_area=_D, meta=_land("nature_light")),
    7: Rule(
        either(any_of("landuse", "allotments", "greenhouse_horticulture", "recreation_ground"), any_of("leisure", "stadium", "playground", "garden", "park")),
        "landuse", by_area=_D, meta=_land("park"),
    ),
    8: Rule(is_("landuse", "cemetery"), "landuse", by_area=_D, meta=_land("cemetery")),
    9: Rule(any_of("landuse", "construction", "greenfield", "brownfield"), "construction", by_area=_D),
    10: Rule(
        either(is_("natural", "water"), is_("leisure", "swimming_pool"), any_of("waterway", "pond", "basin", "riverbank")),
        "water", by_area=((12, 10**6), (10, 10**4), (0, -1)),
    ),
    11: Rule(is_("natural", "beach"), "landuse", by_area=_D, meta=_land("beach")),
    12: Rule(either(is_("amenity", "parking"), any_of("highway", "service", "pedestrian")), "pedestrian", by_area=((12, 10**8), (10, 10**10), (8, -1))),
    13: Rule(is_("leisure", "pitch"), "sport", by_area=((14, 10**8), (12, 10**10), (8, -1))),
}

DEFAULT = Profile(
    node=(
        Rule(is_("place", "city"), "cities", 5, meta=_PLACE),
        Rule(any_of("place", "borough", "town"), "cities", 9, meta=_PLACE),
        Rule(any_of("place", "village", "suburb"), "cities", 11, meta=_PLACE),
        Rule(any_of("place"), "cities", None, meta=_PLACE),
    ),
    way=(*_roads((*_STREETS, *_SMALL_PATHS), (), 12), *_rails(("tram", "subway", "rail"), ("tram", "subway")), *_WATERWAYS),
    area=tuple(_AREA.values()),
)

BACKGROUND = Profile(
    node=(
        Rule(is_("place", "country"), "region", 3, meta=_PLACE),
        Rule(any_of("place", "province", "region", "state"), "region", 7, meta=_PLACE),
        Rule(is_("place", "city"), "cities", 6, meta=_PLACE),
        *DEFAULT.node[1:3],
    ),
    way=(*_roads(_STREETS, _SMALL_PATHS, 14), *_rails(("narrow_gauge", "tram", "subway", "light_rail", "rail"), ("narrow_gauge", "light_rail", "tram", "subway")), *_WATERWAYS),
    area=tuple(r for n, r in _AREA.items() if n not in (2, 3, 5, 6, 7)),
)
