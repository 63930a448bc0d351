"""Steps whose memory or time once outgrew the input: plans and kernels as they must stay."""

import random
import zipfile
import zlib

import numpy as np
from pyspark.sql import functions as F
from pyspark.util import PythonEvalType

from quadloom import sources
from quadloom.functions import geometry as geo
from quadloom.operators import coast, kernels, mvt, shapes
from quadloom.plans import render
from quadloom.sources import osm_pbf, shapefile


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_multipolygons_broadcast_nothing(spark):
    square = [(0, 0), (9, 0), (9, 9), (0, 9), (0, 0)]
    members = spark.createDataFrame([(1, 2, "outer"), (1, 1, "outer"), (1, 3, "inner"), (2, 4, None)], "relation_id long, way_id long, role string")
    lines = spark.createDataFrame([(1, square[:3]), (2, square[2:]), (3, [(1, 1), (3, 1), (3, 3), (1, 1)]), (4, square)], "way_id long, points array<struct<x:bigint,y:bigint>>")
    made = shapes.multipolygons(members, lines)
    assert "Broadcast" not in plan(made)
    got = {r["relation_id"]: (r["n_parts"], [[len(ring) for ring in p] for p in r["parts"]]) for r in made.collect()}
    assert got == {1: (1, [[5, 4]]), 2: (0, [])}


def test_nested_and_packed_are_inverse():
    rows = [[[[(1, 2), (3, 4)], [(5, 6)]], []], [], [[[(7, 8)]]]]
    a = shapes.packed(rows, 3)
    assert shapes.nested(a) == rows and shapes.nested(a.slice(1)) == rows[1:]
    assert shapes.nested(shapes.packed([], 3)) == [] and shapes.nested(shapes.packed([[]], 3)) == [[]]


def test_prepared_squares_lie_in_the_world(spark):
    rows = [(1, 10, 0, 5, "[[[(5, 5)]]]"), (2, 1024, 3, 0, ""), (3, 3, -1, 0, "")]
    store = spark.createDataFrame([(i, "road", z, 21, 1, (cx << 22) + 5, (cy << 22) + 5, cx, cy) for i, cx, cy, z, _ in rows], "id long, layer string, min_z int, max_z int, geom_type int, px long, py long, cell_x long, cell_y long")
    store = store.selectExpr("*", "array(array(array(struct(px as x, py as y)))) as parts", "px as min_x", "py as min_y", "px as max_x", "py as max_y")
    none = spark.createDataFrame([], "key string, value struct<vtype:tinyint,s:string,d:double,i:bigint>")
    store = store.crossJoin(none.selectExpr("collect_list(struct(key, value)) as meta")).drop("px", "py")
    assert sorted((r["z"], r["x"], r["y"]) for r in render.prepare_tiles(store).collect()) == [(z, 10 >> (10 - z), 0) for z in range(5, 11)]


def test_nested_geometry_expressions_compute_their_points_once(spark):
    x = F.col("id")
    area = geo.ring_area(geo.close_ring(geo.quantize(geo.box_ring(x, x, x + 5000, x + 9000), F.lit(10))))
    assert str(spark.range(3).select(area)._jdf.queryExecution().optimizedPlan()).count("shiftright") == 6  # x, y and the half, and again in the name; 170 when unbound


def test_rectangles_are_cut_as_by_the_kernels(spark):
    rng = random.Random(5)
    box, rows = (0, 0, 9000, 7000), []
    for i in range(300):
        x0, y0, x1, y1 = (rng.choice((-4000, 0, 1000, 1500, 7000, 9000, 12000)) + rng.randint(0, 1) * rng.randint(0, 2000) for _ in range(4))
        ring = [(x0, y0), (x1, y0), (x1, y1), (x0, y1)] if rng.random() < 0.5 else [(x0, y0), (x0, y1), (x1, y1), (x1, y0)]
        ring = ring[i % 4 :] + ring[: i % 4]
        rows.append((i, rng.choice(("water", "coastline")), 3, rng.randint(10, 20), *box, [[[*ring, ring[0]] if rng.random() < 0.7 else ring]]))
    df = spark.createDataFrame(rows, f"id long, layer string, geom_type int, z long, draw_min_x long, draw_min_y long, draw_max_x long, draw_max_y long, parts {shapes.PARTS}")
    for drop in (False, True):
        want = {}
        for i, layer, kind, z, *_, parts in rows:
            made = shapes.shift(kind, shapes.clip(kind, parts, box), z)
            if made and not (drop and layer != "coastline" and shapes.area(made) < 256):
                want[i] = made
        got = {r["id"]: [[[tuple(p) for p in ring] for ring in part] for part in r["parts"]] for r in shapes.clip_and_shift(df, drop).collect()}
        assert got == want and 0 < len(got) < 300
    shaped = df.where(shapes.is_rectangle(F.col("parts")))
    assert shaped.count() > 150


def test_all_lines_at_once_keep_what_each_keeps():
    rng = random.Random(3)
    lines = [[(rng.randint(0, 1 << e), rng.randint(0, 1 << e)) for _ in range(rng.randint(0, 40))] for e in [1, 3, 8, 14, 25, 28, 32] * 30]
    lines += [[(0, 0), (5, 5), (0, 0)], [(1, 1)] * 4, [(0, 0), (2, 0), (4, 0), (6, 1)]]
    flat = np.array([p for line in lines for p in line], dtype=np.int64)
    at = np.cumsum([0, *map(len, lines)])
    got = kernels.keep_zooms_of_all(flat[:, 0], flat[:, 1], at).tolist()
    for line, a, b in zip(lines, at, at[1:]):
        assert got[a:b] == (kernels.keep_zooms(line) if line else []), line


def test_keep_zooms_makes_no_object_per_point(spark):
    lines = spark.createDataFrame([(1, [(0, 0), (50, 1), (100, 0), (100, 100)]), (2, [])], "id long, points array<struct<x:bigint,y:bigint>>")
    kept = lines.select("id", shapes.keep_zooms(F.col("points")).alias("keep"))
    assert {r["id"]: r["keep"] for r in kept.collect()} == {1: kernels.keep_zooms([(0, 0), (50, 1), (100, 0), (100, 100)]), 2: []}
    assert "SQL_SCALAR_ARROW_UDF" in plan(kept) or "ArrowEvalPython" in plan(kept)


def test_parts_are_bounded_and_written_as_rows_come(spark, tmp_path):
    folder, size = str(tmp_path / "parts"), []
    (tmp_path / "parts").mkdir()

    def write(path, rows):
        assert iter(rows) is rows
        with open(path, "w") as f:
            f.writelines(f"{i}\n" for (i,) in rows)

    assert sources.write_parts(spark.range(0, 1000, 1, 2), folder, ".txt", write, part_rows=300) == 4
    for p in (tmp_path / "parts").glob("*.txt"):
        size += [int(v) for v in p.read_text().split()]
    assert sorted(size) == list(range(1000))


def test_a_file_of_nodes_is_made_block_by_block(tmp_path):
    alive = 0

    def rows():
        for i in range(5000):
            if i == 2500:
                nonlocal alive
                alive = (tmp_path / "n.pbf").stat().st_size
            yield "node", i, 1.0, 2.0, {}, None, None

    osm_pbf.write(str(tmp_path / "n.pbf"), rows(), per_block=10)
    assert alive > 0 and sum(1 for kind, _, _ in osm_pbf.blob_headers(str(tmp_path / "n.pbf")) if kind == "OSMData") == 500


def test_a_shapefile_takes_time_in_proportion(tmp_path):
    ring = [[(0.0, 0.0), (0.0, 1.0), (1.0, 1.0), (0.0, 0.0)]]
    shapefile.write(str(tmp_path / "a.zip"), (ring for _ in range(100_000)))  # minutes when bytes were added up
    with zipfile.ZipFile(tmp_path / "a.zip") as z, z.open("land.shp") as f:
        assert sum(1 for _ in shapefile.shapes(f)) == 100_000


def test_land_is_counted_by_tile_before_it_meets_the_squares(spark):
    land = spark.range(1000).selectExpr("id * 1000 as min_x", "id * 1000 as min_y", "id * 1000 + 500 as max_x", "id * 1000 + 500 as max_y")
    roots = spark.createDataFrame([(9, x, 0) for x in range(3)], "z long, x long, y long")
    made = coast.descend(land, roots, 10)
    assert "BroadcastHashJoin" not in plan(made)
    assert {(r["z"], r["x"], r["y"]): r["kind"] for r in made.collect()} == {(9, 1, 0): "sea", (9, 2, 0): "sea", (10, 0, 0): "coast", (10, 1, 0): "sea", (10, 0, 1): "sea", (10, 1, 1): "sea"}


def test_bytes_are_compressed_from_the_batch(spark):
    df = spark.createDataFrame([(b"a" * 500,), (None,), (b"",)], "b binary").select("b", shapes.deflate(F.col("b")).alias("d"))
    assert [None if r["d"] is None else zlib.decompress(r["d"]) for r in df.collect()] == [b"a" * 500, None, b""]
    assert "SQL_SCALAR_ARROW_UDF" in plan(df) or shapes.deflate.evalType == PythonEvalType.SQL_SCALAR_ARROW_UDF


def test_a_layer_of_many_features_takes_time_in_proportion():
    spot = {"geom_type": 1, "parts": [[[(3, 4)]]], "meta": []}
    data = mvt.encode_layer("l", [{"id": i, **spot} for i in range(200_000)], (0, 0))  # minutes when bytes were added up
    assert len(data) > 200_000 * 10


def test_sea_squares_broadcast_no_land(spark):
    land = spark.createDataFrame([(0, 0, 9, 9, [[[(0, 0), (9, 0), (9, 9), (0, 9), (0, 0)]]])], f"min_x long, min_y long, max_x long, max_y long, parts {shapes.PARTS}")
    asked = spark.createDataFrame([(10, 0, 0)], "z long, x long, y long")
    made = coast.sea_polygons(asked, land)
    assert plan(made).count("SortMergeJoin") == 1
    assert made.first()["area"] == ((1 << 22) + 8192) ** 2 - 81
