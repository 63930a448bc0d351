"""The geometry kernels, the wire formats and the merge of lines, without Spark."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quadloom.operators import kernels as k
from quadloom.operators import mvt
from quadloom.operators import protobuf as pb
from quadloom.sources import osm_pbf, shapefile

BOX = (10, 10, 20, 20)


def test_clip_line_examples():
    assert k.clip_line([(0, 0), (0, 30)], BOX) == []
    assert k.clip_line([(12, 12), (18, 18)], BOX) == [[(12, 12), (18, 18)]]
    assert k.clip_line([(12, 8), (12, 12)], BOX) == [[(12, 10), (12, 12)]]
    assert k.clip_line([(5, 15), (25, 15), (25, 12), (5, 12)], BOX) == [[(10, 15), (20, 15)], [(20, 12), (10, 12)]]


@pytest.mark.parametrize(
    ("lines", "want"),
    [
        ([[10, 11], [11, 12]], [[10, 11, 12]]),
        ([[10, 11], [12, 11]], [[10, 11, 12]]),
        ([[10, 11], [12, 10]], [[12, 10, 11]]),
        ([[10, 11], [10, 12]], [[12, 10, 11]]),
        ([[10, 11], [11, 12], [12, 13]], [[10, 11, 12, 13]]),
        ([[10, 11], [11, 12], [11, 13]], [[10, 11], [11, 12], [11, 13]]),
        ([[10, 11, 10], [10, 12]], [[10, 11, 10], [10, 12]]),
    ],
)
def test_merge_lines(lines, want):
    got = k.merge_lines([[(v, v) for v in line] for line in lines])
    assert [[x for x, _ in line] for line in got] == want


def test_oneway_lines_keep_their_direction():
    assert len(k.merge_lines([[(0, 0), (1, 1)], [(2, 2), (1, 1)]], [True, True])) == 2
    assert len(k.merge_lines([[(0, 0), (1, 1)], [(1, 1), (2, 2)]], [True, True])) == 1
    assert len(k.merge_lines([[(0, 0), (1, 1)], [(1, 1), (2, 2)]], [True, False])) == 2


def _area(polygons):
    return sum(abs(k.area2(r[:-1])) / 2 * (1 if i == 0 else -1) for p in polygons for i, r in enumerate(p))


def test_clip_polygon_examples():
    square = [(0, 0), (10, 0), (10, 10), (0, 10), (0, 0)]
    assert _area(k.clip_polygon([square], (0, 0, 5, 5))) == 25
    assert k.clip_polygon([square], (20, 20, 22, 22)) == []
    assert _area(k.clip_polygon([square], (2, 2, 4, 4))) == 4
    comb = [(0, 0), (30, 0), (30, 30), (20, 30), (20, 10), (10, 10), (10, 30), (0, 30), (0, 0)]
    parts = k.clip_polygon([comb], (-5, 20, 35, 40))
    assert len(parts) == 2 and _area(parts) == 200
    ring = [[(0, 0), (30, 0), (30, 30), (0, 30), (0, 0)], [(10, 10), (20, 10), (20, 20), (10, 20), (10, 10)]]
    assert _area(k.clip_polygon(ring, (-1, -1, 31, 31))) == 800
    assert _area(k.clip_polygon(ring, (5, 5, 25, 15))) == 200 - 50


def even_odd_area(rings, box):
    """Area of the rings' even-odd region in the box, by slabs between all heights at which anything happens."""
    edges = [(a, b) for r in rings for a, b in zip(r, r[1:] + r[:1]) if a[1] != b[1]]
    heights = {box[1], box[3], *(p[1] for r in rings for p in r)}
    for i, (a, b) in enumerate(edges):
        for c, d in edges[:i]:
            den = (b[0] - a[0]) * (d[1] - c[1]) - (b[1] - a[1]) * (d[0] - c[0])
            if den:
                t = ((c[0] - a[0]) * (d[1] - c[1]) - (c[1] - a[1]) * (d[0] - c[0])) / den
                heights.add(a[1] + t * (b[1] - a[1])) if 0 <= t <= 1 else None
        for x in (box[0], box[2]):
            if (a[0] - x) * (b[0] - x) < 0:
                heights.add(a[1] + (x - a[0]) / (b[0] - a[0]) * (b[1] - a[1]))
    total, heights = 0.0, sorted(y for y in heights if box[1] <= y <= box[3])
    for low, high in zip(heights, heights[1:]):
        y = (low + high) / 2
        xs = sorted(a[0] + (y - a[1]) / (b[1] - a[1]) * (b[0] - a[0]) for a, b in edges if min(a[1], b[1]) < y < max(a[1], b[1]))
        total += sum(max(0, min(v, box[2]) - max(u, box[0])) for u, v in zip(xs[::2], xs[1::2])) * (high - low)
    return total


def check_clip(rings, box):
    got = k.clip_polygon([[*r, r[0]] for r in rings], box)
    want = even_odd_area(rings, box)
    assert abs(_area(got) - want) <= 25_000  # cut points are rounded
    for p in got:
        assert k.area2(p[0][:-1]) > 0 and all(k.area2(r[:-1]) < 0 for r in p[1:])
        for r in p:
            assert r[0] == r[-1] and all(box[0] <= x <= box[2] and box[1] <= y <= box[3] for x, y in r)
    # what is left of the box is the rest of it
    assert abs(_area(k.subtract(box, [rings])) + want - (box[2] - box[0]) * (box[3] - box[1])) <= 25_000


@pytest.mark.parametrize("block", range(10))
def test_clipped_parts_lie_in_the_box_and_hold_its_share(block):
    import math

    for seed in range(block * 1000, block * 1000 + 1000):
        rng = random.Random(seed)
        n = rng.randint(3, 12)
        angles = sorted(rng.uniform(0, 2 * math.pi) for _ in range(n))
        star = [(round(5000 + rng.uniform(500, 4000) * math.cos(a)), round(5000 + rng.uniform(500, 4000) * math.sin(a))) for a in angles]
        check_clip([star], (rng.randint(0, 5000), rng.randint(0, 5000), rng.randint(5001, 10000), rng.randint(5001, 10000)))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.tuples(st.integers(0, 11), st.integers(0, 11)), min_size=3, max_size=9), min_size=1, max_size=3))
def test_points_and_edges_on_the_box(rings):
    check_clip([[(1_000 * x, 1_000 * y) for x, y in r] for r in rings], (2_000, 3_000, 8_000, 9_000))


def test_subtract():
    assert _area(k.subtract((0, 0, 10, 10), [])) == 100
    assert _area(k.subtract((0, 0, 10, 10), [[[(2, 2), (4, 2), (4, 4), (2, 4), (2, 2)]]])) == 96
    assert _area(k.subtract((0, 0, 10, 10), [[[(-5, -5), (5, -5), (5, 15), (-5, 15), (-5, -5)]]])) == 50
    assert _area(k.subtract((0, 0, 10, 10), [[[(0, 0), (4, 0), (4, 4), (0, 4)]]])) == 84
    assert _area(k.subtract((0, 0, 10, 10), [[[(0, 0), (4, 0), (4, 4), (0, 4)]], [[(4, 0), (9, 0), (9, 4), (4, 4)]]])) == 64
    assert k.subtract((0, 0, 10, 10), [[[(-5, -5), (15, -5), (15, 15), (-5, 15), (-5, -5)]]]) == []


def test_simplify():
    line = [(0, 0), (50, 1), (100, 0), (100, 100)]
    assert k.douglas_peucker(line, 2) == [0, 2, 3]
    zooms = k.keep_zooms(line)
    assert zooms[0] == zooms[3] == 0 and zooms[1] > zooms[2]


def test_tile_round_trip():
    value = lambda **x: {"vtype": 2, "s": None, "d": None, "i": None} | x
    road = {"id": 7, "geom_type": 2, "parts": [[[(5, 5), (9, 5), (9, 9)]], [[(1, 1), (2, 2)]]], "meta": [("name", value(s="a")), ("__x", value(s="b")), ("n", value(vtype=3, d=1.5)), ("i", value(vtype=4, i=-3)), ("t", value(vtype=1))]}
    area = {"id": 8, "geom_type": 3, "parts": [[[(0, 0), (10, 0), (10, 10), (0, 0)], [(2, 1), (3, 1), (3, 2), (2, 1)]]], "meta": []}
    spot = {"id": 9, "geom_type": 1, "parts": [[[(3, 4), (5, 6)]]], "meta": [("name", value(s="a"))]}
    layers = mvt.decode_tile(mvt.encode_tile([("road", [road]), ("empty", []), ("mix", [area, spot])], (0, 0)))
    assert [x["name"] for x in layers] == ["road", "mix"] and all(x["version"] == 2 and x["extent"] == 4096 for x in layers)
    assert layers[0]["features"] == [{"id": 7, "type": 2, "geometry": [[(5, 5), (9, 5), (9, 9)], [(1, 1), (2, 2)]], "tags": {"name": "a", "n": 1.5, "i": -3, "t": True}}]
    assert layers[1]["features"][0]["geometry"] == area["parts"][0] and layers[1]["features"][1]["geometry"] == [[(3, 4), (5, 6)]]
    with pytest.raises(ValueError):
        mvt.encode_geometry(2, [[[(1, 1), (1, 1)]]], (0, 0))


@given(st.integers(-(1 << 62), 1 << 62))
def test_varints(n):
    assert pb.unzigzag(pb.read_varint(pb.varint(pb.zigzag(n)), 0)[0]) == n


def test_pbf_file(tmp_path):
    rows = [("node", 5, 49.8, 8.6, {"place": "city"}, None, None), ("node", 3, -1.5, -170.25, {}, None, None), ("way", 9, None, None, {"highway": "path"}, [5, 3, 5], None), ("relation", 11, None, None, {"type": "multipolygon"}, None, [("way", 9, "outer"), ("node", 3, "")])]
    path = str(tmp_path / "x.osm.pbf")
    osm_pbf.write(path, rows, per_block=3)
    blobs = [(at, n) for kind, at, n in osm_pbf.blob_headers(path) if kind == "OSMData"]
    data = open(path, "rb").read()
    got = [r for at, n in blobs for r in osm_pbf.primitives(osm_pbf._unpack(data[at : at + n]))]
    assert [(r[0], r[1], r[4], r[5], r[6]) for r in got] == [(r[0], r[1], r[4], r[5], r[6]) for r in rows]
    assert abs(got[0][2] - 49.8) < 1e-7 and abs(got[1][3] + 170.25) < 1e-7


def test_shapefile(tmp_path):
    path = str(tmp_path / "land.zip")
    rings = [[(0.0, 0.0), (0.0, 5.0), (5.0, 5.0), (0.0, 0.0)], [(1.0, 2.0), (2.0, 3.0), (1.0, 3.0), (1.0, 2.0)]]
    shapefile.write(path, [rings, rings[:1]])
    import zipfile

    with zipfile.ZipFile(path) as z:
        assert list(shapefile.shapes(z.read("land.shp"))) == [(1, rings), (2, rings[:1])]
