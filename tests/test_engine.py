"""The engine in Spark: examples with known results, plans, and all queries against their SQL."""

import os
import zlib

import duckdb
import pytest

import quadloom.queries as registry
from quadloom import fixtures as fx
from quadloom.operators import mvt, spatial, tables, tilesets
from quadloom.plans import render

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("set timezone='UTC'")
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        c.sql(f"create view {t} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return c


def _plain(v):
    return round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    want = duck.sql(registry.oracle_sql()[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert sorted((tuple(_plain(r[c]) for c in columns) for r in df.collect()), key=repr) == sorted((tuple(_plain(r[i]) for i in at) for r in want.fetchall()), key=repr)


def tile_set(spark, rows):
    return spark.createDataFrame(rows, "z long, x long, y long")


def got(df):
    return sorted(map(tuple, df.collect()))


def test_tile_sets(spark):
    one = tile_set(spark, [(1, 0, 0)])
    assert got(tilesets.covered(tile_set(spark, [(1, 0, 0), (0, 0, 0), (2, 0, 0), (1, 1, 0), (2, 2, 2)]), one)) == [(1, 0, 0), (2, 0, 0)]
    two = tile_set(spark, [(2, 0, 1), (2, 3, 3)])
    assert got(tilesets.covered(tile_set(spark, [(2, 0, 1), (8, 42, 48)]), two)) == [(2, 0, 1)]
    under = tilesets.leaves_under(tile_set(spark, [(1, 0, 0), (8, 200, 200), (3, 7, 0)]), two)
    assert got(under) == [(1, 0, 0, 2, 0, 1), (8, 200, 200, 8, 200, 200)]
    assert got(tilesets.normalize(tile_set(spark, [(1, 0, 0), (2, 1, 1), (2, 2, 2)]))) == [(1, 0, 0), (2, 2, 2)]


def test_quad_walk(spark):
    entries = spark.createDataFrame([(2, 0, 0, 1, 3), (4, 0, 2, 5, 1), (4, 0, 0, 4, 1)], "z long, x long, y long, offset long, size long")
    pairs = spatial.walk(tile_set(spark, [(0, 0, 0), (3, 0, 0), (4, 0, 2), (5, 0, 4)]), entries)
    found = {}
    for r in pairs.collect():
        found.setdefault((r["z"], r["x"], r["y"]), set()).add((r["eoffset"], r["esize"]))
    assert found == {(0, 0, 0): {(1, 3), (5, 1), (4, 1)}, (3, 0, 0): {(1, 3), (4, 1)}, (4, 0, 2): {(1, 3), (5, 1)}, (5, 0, 4): {(1, 3), (5, 1)}}


def test_islands_and_missing_nodes(spark):
    ids = spark.createDataFrame([(i,) for i in (42, 44, 45, 46, 65535, 65536)], "id long")
    assert got(tables.islands(ids, "id")) == [(42, 42, 1), (44, 46, 3), (65535, 65536, 2)]
    nodes = spark.createDataFrame([(42, 1, 2), (-44, 3, 4)], "node_id long, x long, y long")
    refs = spark.createDataFrame([(1, 0, 42), (1, 1, -42), (1, 2, 43), (1, 3, 44)], "way_id long, pos long, ref long")
    assert sorted((r["pos"], r["x"]) for r in tables.locate_way_nodes(refs, nodes).collect()) == [(0, 1), (1, 1), (2, None), (3, 3)]


def test_tiles_decode_and_hold_what_was_asked(spark):
    store = render.import_features(fx.features(spark, SF))
    asked = fx.requests(spark, zooms=(10, 10))
    drawn = render.render(store, asked)
    want = {(r["z"], r["x"], r["y"]): r["count"] for r in drawn.groupBy("z", "x", "y").count().collect()}
    made = render.get_tiles(store, asked).collect()
    assert {(r["z"], r["x"], r["y"]): r["n_features"] for r in made} == want
    for r in made:
        layers = mvt.decode_tile(zlib.decompress(bytes(r["mvt"])))
        assert sum(len(x["features"]) for x in layers) == r["n_features"]
        assert {x["name"] for x in layers} <= {"cities", "road", "building", "landuse", "water"}


def test_spatial_join_is_on_keys(spark):
    plan = spatial.match(registry.tile_queries.rect_store(spark, SF), fx.requests(spark))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
