"""Quad-tree walks, sets of squares, roll-ups and the coast descent."""

from pyspark.sql import functions as F

from quadloom import fixtures as fx
from quadloom.constants import CELL_ZOOM
from quadloom.fixtures import sql
from quadloom.functions import tilemath as tm
from quadloom.operators import coast, spatial, tilesets
from quadloom.queries import query
from quadloom.queries.tile_queries import BOX, best_sql

c = F.col

#: a tile (az, ax, ay) is tile b or above it
_ABOVE = "{a}.z <= {b}.z AND ({b}.x >> CAST(greatest({b}.z - {a}.z, 0) AS INT)) = {a}.x AND ({b}.y >> CAST(greatest({b}.z - {a}.z, 0) AS INT)) = {a}.y"


def above(a: str, b: str) -> str:
    return _ABOVE.format(a=a, b=b)


def _best(spark, sf):
    rows = spatial.assign_cells(fx.rects(spark, sf)).withColumn("t", tm.best_tile(c("cell_x"), c("cell_y"), *map(c, BOX)))
    return rows.select("id", "w", "h", "cell_x", "cell_y", "t.z", "t.x", "t.y")


_SEA_ANY = "EXISTS (SELECT 1 FROM fx_seaside s WHERE " + above("s", "r") + ")"


@query("seaside_semi", sql(f"SELECT z, x, y FROM fx_requests r WHERE {_SEA_ANY}", "fx_requests", "fx_seaside"))
def run_seaside_semi(spark, sf):
    return tilesets.covered(fx.requests(spark), fx.seaside(spark, sf))


# the shallow entries cover all that is asked for: the deep ones by themselves leave most of it
@query("seaside_anti", sql(f"SELECT z, x, y FROM fx_requests r WHERE NOT {_SEA_ANY.replace('WHERE ', 'WHERE s.z >= 8 AND ')}", "fx_requests", "fx_seaside"))
def run_seaside_anti(spark, sf):
    return tilesets.covered(fx.requests(spark), fx.seaside(spark, sf).where("z >= 8"), "left_anti")


_NORMAL = "n AS (SELECT * FROM fx_seaside s WHERE NOT EXISTS (SELECT 1 FROM fx_seaside p WHERE p.z < s.z AND " + above("p", "s") + "))"


@query("seaside_normalize", f"WITH fx_seaside AS ({fx.SQL['fx_seaside']}), {_NORMAL} SELECT z, x, y FROM n")
def run_seaside_normalize(spark, sf):
    return tilesets.normalize(fx.seaside(spark, sf))


_SHALLOW = "q AS (SELECT CAST(6 AS BIGINT) + i % 4 AS z, ((CAST(2248146944 AS BIGINT) + i * 4000037) >> CAST(32 - (6 + i % 4) AS INT)) AS x, ((CAST(1447034880 AS BIGINT) + i * 4000037) >> CAST(32 - (6 + i % 4) AS INT)) AS y FROM (SELECT unnest(range(CAST(0 AS BIGINT), CAST(16 AS BIGINT))) AS i))"


def _shallow(spark):
    i = c("id")
    z = 6 + i % 4
    return spark.range(16).select(z.alias("z"), tm.pixel_to_tile(fx.X0 + i * 4000037, z).alias("x"), tm.pixel_to_tile(fx.Y0 + i * 4000037, z).alias("y"))


@query("seaside_leafs", f"""WITH fx_seaside AS ({fx.SQL['fx_seaside']}), {_NORMAL}, {_SHALLOW}
SELECT DISTINCT q.z AS qz, q.x AS qx, q.y AS qy, q.z, q.x, q.y FROM q JOIN n ON {above("n", "q")}
UNION SELECT q.z, q.x, q.y, n.z, n.x, n.y FROM q JOIN n ON n.z > q.z AND {above("q", "n")}""")
def run_seaside_leafs(spark, sf):
    return tilesets.leaves_under(_shallow(spark), tilesets.normalize(fx.seaside(spark, sf)))


@query("quad_walk", best_sql(f", {_SHALLOW}".lstrip(", ") and f"""SELECT q.z AS qz, q.x AS qx, q.y AS qy, e.id, e.z, e.x, e.y FROM ({_SHALLOW[6:-1]}) q JOIN best e ON ({above("q", "e")}) OR ({above("e", "q")})"""))
def run_quad_walk(spark, sf):
    pairs = spatial.walk(_shallow(spark), _best(spark, sf).select("z", "x", "y", "id"))
    return pairs.select(*[c(k).alias(f"q{k}") for k in "zxy"], c("eid").alias("id"), *[c(f"e{k}").alias(k) for k in "zxy"])


@query("quad_rollup", best_sql("""SELECT a AS z, x >> CAST(z - a AS INT) AS x, y >> CAST(z - a AS INT) AS y, CAST(sum(CASE WHEN a = z THEN w ELSE 0 END) AS BIGINT) AS size_self, CAST(sum(w) AS BIGINT) AS size_subtree, min(id) AS first_offset
  FROM (SELECT b.z, b.x, b.y, b.id, r.w, unnest(range(CAST(10 AS BIGINT), b.z + 1)) AS a FROM best b JOIN fx_rects r USING (id)) GROUP BY ALL"""))
def run_quad_rollup(spark, sf):
    return tilesets.rollup(_best(spark, sf).select("z", "x", "y", c("w").alias("size"), c("id").alias("offset")), CELL_ZOOM)


@query("span_group", best_sql("""SELECT cell_x, cell_y, 8 + id % 4 AS min_z, z, x, y, min(id) AS first_id, count(*) AS n FROM best GROUP BY ALL"""))
def run_span_group(spark, sf):
    return _best(spark, sf).groupBy("cell_x", "cell_y", (8 + c("id") % 4).alias("min_z"), "z", "x", "y").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("n"))


_TOUCH = "SELECT 1 FROM fx_rects f WHERE f.min_x <= ((t.x + 1) << CAST(32 - t.z AS INT)) AND f.max_x >= (t.x << CAST(32 - t.z AS INT)) AND f.min_y <= ((t.y + 1) << CAST(32 - t.z AS INT)) AND f.max_y >= (t.y << CAST(32 - t.z AS INT))"
_HOLD = "SELECT 1 FROM fx_rects f WHERE f.min_x <= (t.x << CAST(32 - t.z AS INT)) AND f.max_x >= ((t.x + 1) << CAST(32 - t.z AS INT)) AND f.min_y <= (t.y << CAST(32 - t.z AS INT)) AND f.max_y >= ((t.y + 1) << CAST(32 - t.z AS INT))"
_ROOTS = [(9, 268 + a, 172 + b) for a in range(8) for b in range(8)]


def _level(z: int) -> str:
    source = "SELECT * FROM (VALUES " + ", ".join(f"(CAST({z} AS BIGINT), CAST({x} AS BIGINT), CAST({y} AS BIGINT))" for z, x, y in _ROOTS) + ") v(z, x, y)" if z == 9 else f"SELECT z + 1 AS z, x * 2 + k % 2 AS x, y * 2 + k // 2 AS y FROM (SELECT *, unnest(range(CAST(0 AS BIGINT), CAST(4 AS BIGINT))) AS k FROM l{z - 1} WHERE touching AND NOT holding)"
    return f"l{z} AS (SELECT t.z, t.x, t.y, EXISTS ({_TOUCH}) AS touching, EXISTS ({_HOLD}) AS holding FROM ({source}) t)"


@query("coast_descent", f"WITH fx_rects AS ({fx.SQL['fx_rects']}), " + ", ".join(map(_level, range(9, 13))) + " " + " UNION ALL ".join(
    f"SELECT z, x, y, CASE WHEN holding THEN 'land' WHEN touching THEN 'coast' ELSE 'sea' END AS kind FROM l{z} WHERE holding OR NOT touching OR z = 12" for z in range(9, 13)))
def run_coast_descent(spark, sf):
    return coast.descend(fx.rects(spark, sf), spark.createDataFrame(_ROOTS, "z long, x long, y long"), 12)
