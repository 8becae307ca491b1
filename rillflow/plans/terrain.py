"""Queries on drainage, descents, basins, outlines, thinned lines, waves of tiles and the projection, with the SQL that states their results.

Grids are those of ``shapes``. The pitted grid has levels 0 to 24, with pits and flats throughout; SQL fills it level by level: a cell's
filled level is the least at which cells not above it lead to the rim.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillflow.functions import projection
from rillflow.operators import drainage, hydro, outlines, spatial
from rillflow.plans import basin, waves
from rillflow.plans import queries as Q
from rillflow.plans import shapes as X
from rillflow.plans.queries import query
from rillflow.session import Rounds
from rillflow.sources.layers import table

#: Small tiles, so that the given grids have many.
TILE = 32

_PITS = "k * 7919 % 17 + abs(k % 50 - 25) div 3"
_PITSQL = X.sql_cells("p_partkey * 7919 % 17 + abs(p_partkey % 50 - 25) // 3")
_MOVES = "m AS (SELECT * FROM (VALUES (1, -1, 1), (2, -1, 0), (3, -1, -1), (4, 0, -1), (5, 1, -1), (6, 1, 0), (7, 1, 1), (8, 0, 1)) m(code, dr, dc))"


def _ways(cells: str, levels: int) -> str:
    """Filled levels (f), steepest ways (w), ways over flats (b), the ways taken (t) and all cells that each cell's water passes (p)."""
    return f"""g AS MATERIALIZED {cells}, {_MOVES},
e AS MATERIALIZED (SELECT a.k, b.k AS to_k, code, a.z, b.z AS to_z FROM g a, m JOIN g b ON b.r = a.r + dr AND b.c = a.c + dc),
rim AS MATERIALIZED (SELECT k, z FROM g WHERE (SELECT count(*) FROM e WHERE e.k = g.k AND code % 2 = 0) < 4),
s AS (SELECT t, k FROM rim, (SELECT unnest(range(0, {levels})) AS t) WHERE z <= t UNION SELECT s.t, e.to_k FROM s JOIN e ON e.k = s.k AND e.to_z <= s.t),
f AS MATERIALIZED (SELECT k, min(t) AS f FROM s GROUP BY 1),
n AS MATERIALIZED (SELECT e.k, e.to_k, code, (a.f - b.f) / CASE WHEN code % 2 = 1 THEN sqrt(2.0) ELSE 1.0 END AS d FROM e JOIN f a ON a.k = e.k JOIN f b ON b.k = e.to_k),
w AS MATERIALIZED (SELECT k, to_k, code FROM n WHERE d > 0 QUALIFY row_number() OVER (PARTITION BY k ORDER BY d DESC, code) = 1),
b(k, d) USING KEY (k) AS (SELECT k, 0 FROM (SELECT k FROM w UNION SELECT k FROM rim) UNION
  SELECT n.to_k, min(b.d + 1) FROM b JOIN n ON n.k = b.k AND n.d = 0 WHERE NOT EXISTS (SELECT 1 FROM recurring.b AS x WHERE x.k = n.to_k) GROUP BY 1),
o AS MATERIALIZED (SELECT n.k, n.to_k, code FROM n JOIN b x ON x.k = n.k JOIN b y ON y.k = n.to_k WHERE n.d = 0 AND y.d = x.d - 1 AND n.k NOT IN (SELECT k FROM w) QUALIFY row_number() OVER (PARTITION BY n.k ORDER BY code) = 1),
t AS MATERIALIZED (SELECT * FROM w UNION ALL SELECT * FROM o),
p AS (SELECT k, k AS place, 0 AS nth FROM g UNION ALL SELECT p.k, t.to_k, nth + 1 FROM p JOIN t ON t.k = p.place),
acc AS MATERIALIZED (SELECT place, CASE WHEN bool_or(r = 0 OR c = 0 OR c = 49 OR r = (SELECT max(r) FROM g)) THEN -count(*) ELSE count(*) END AS acc FROM p JOIN g USING (k) GROUP BY 1)"""


def _pitted(spark: SparkSession, sf: str) -> DataFrame:
    return X.grid(spark, sf, _PITS).select("r", "c", "z")


@query(f"WITH RECURSIVE {_ways(_PITSQL, 25)} SELECT r, c, CAST(f AS DOUBLE) AS filled, coalesce(code, 0) AS code, acc FROM g JOIN f USING (k) LEFT JOIN t USING (k) JOIN acc ON acc.place = g.k")
def filled_drainage(spark, sf):
    """Filled levels, directions over slopes and flats, and accumulation of a grid full of pits."""
    return drainage.accumulated(drainage.drained(_pitted(spark, sf), TILE)).select("r", "c", "filled", "code", "acc")


@query(f"WITH RECURSIVE {Q._TILTWAYS} SELECT g.r, g.c, coalesce(w.code, 0) AS code, CASE WHEN open > 0 THEN -n ELSE n END AS acc FROM g JOIN acc ON acc.place = g.k LEFT JOIN w ON w.k = g.k")
def grid_drainage(spark, sf):
    return drainage.accumulated(drainage.drained(X.grid(spark, sf, Q._TILT).select("r", "c", "z"), TILE)).select("r", "c", "code", "acc")


def _snaps(ways: str) -> str:
    """The cells that outlets (b, ox, oy, least) of table q0 rank, and the first of them (snap), over cells of ``ways``."""
    return f"""{ways},
x0 AS (SELECT r, c, acc, abs(acc) >= 20 AS channel, k FROM g JOIN acc ON acc.place = g.k),
q AS (SELECT *, CAST(floor(-oy / 10) AS BIGINT) AS r0, CAST(floor(ox / 10) AS BIGINT) AS c0 FROM q0),
x AS (SELECT *, greatest(abs(r - r0), abs(c - c0)) AS far, sqrt(pow((c + 0.5) * 10 - ox, 2) + pow(-(r + 0.5) * 10 - oy, 2)) / 10 AS away FROM q JOIN x0 ON abs(r - r0) <= 40 AND abs(c - c0) <= 40),
y AS (SELECT *, CASE WHEN far <= 5 THEN 0 WHEN far <= 10 THEN 1 WHEN far <= 20 THEN 2 ELSE 3 END AS rung FROM x),
z AS (SELECT *, CASE WHEN channel AND acc > 0 AND acc >= least THEN 0 WHEN channel AND rung = 0 THEN 1 WHEN rung = 0 THEN 2 END AS tier FROM y),
snap AS MATERIALIZED (SELECT * FROM z WHERE tier IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY b ORDER BY tier, CASE WHEN tier = 0 THEN rung ELSE 0 END, CASE WHEN tier < 2 THEN round_even(away, 0) ELSE 0 END, -abs(acc), r, c) = 1)"""


_SUPPLIED = "q0 AS (SELECT s_suppkey AS b, s_suppkey * 53 % 500 + 0.5 AS ox, -(s_suppkey * 29 % (10 * (SELECT max(r) + 1 FROM g)) + 0.5) AS oy, s_suppkey % 4 * 15 AS least FROM supplier)"


def _outlets(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey")
    height = X.grid(spark, sf, "0").agg(F.max("h").alias("height"))  # one row
    rows = table(spark, sf, "supplier").crossJoin(F.broadcast(height))
    return rows.select(k.cast("long").alias("key"), (k * 53 % 500 + 0.5).cast("double").alias("ox"), (-(k * 29 % (10 * F.col("height")) + 0.5)).cast("double").alias("oy"), (k % 4 * 15).cast("double").alias("least"))


@query(f"WITH RECURSIVE {_snaps(f'{_ways(_PITSQL, 25)}, {_SUPPLIED}')} SELECT b AS basin_id, r, c, tier, rung FROM snap")
def snap_outlets(spark, sf):
    """Outlets snapped to the channels of the pitted grid, on the ladder of 50, 100, 200 and 400 m."""
    ways = drainage.accumulated(drainage.drained(_pitted(spark, sf), TILE))
    cells = ways.select("r", "c", "acc", (F.abs("acc") >= 20).alias("channel"))
    return hydro.snapped(cells, _outlets(spark, sf).withColumnRenamed("key", "basin_id"), 10.0)


@query(f"""WITH RECURSIVE {_ways(_PITSQL, 25)}, q AS (SELECT s_suppkey AS b, s_suppkey * 37 % (SELECT count(*) FROM g) AS k FROM supplier)
SELECT b AS basin_id, count(*) AS cells, min(z) AS z_min, max(z) AS z_max, min(g.r) AS top, max(g.r) AS bottom FROM q JOIN p ON p.place = q.k JOIN g ON g.k = p.k GROUP BY 1""")
def basin_cells(spark, sf):
    """Basins of given cells, many within one another, all by one numbering of the drainage."""
    # joined with the one row of the grid's size, cells count as its few bytes, and Spark would broadcast them
    cells = X.grid(spark, sf, _PITS).select("r", "c", "z", "k").hint("merge")
    size = table(spark, sf, "part").agg(F.count("*").alias("n"))  # one row
    at = table(spark, sf, "supplier").crossJoin(F.broadcast(size)).select(F.col("s_suppkey").alias("key"), (F.col("s_suppkey") * 37 % F.col("n")).alias("k"))
    numbers = drainage.numbered(drainage.accumulated(drainage.drained(cells.select("r", "c", "z"), TILE)))
    outlets = at.join(cells, "k").select("key", drainage.place())
    values = cells.select(drainage.place(), "z", "r")
    out = drainage.measured(numbers, outlets, values, ["z", "r"])
    return out.select(F.col("key").alias("basin_id"), "cells", "z_min", "z_max", F.col("r_min").alias("top"), F.col("r_max").alias("bottom"))


@query(f"""WITH RECURSIVE {_ways(_PITSQL, 25)},
q AS (SELECT c_custkey AS b, c_custkey * 53 % (SELECT count(*) FROM g) AS k, c_custkey * 29 % 500 AS x, -(c_custkey * 31 % (10 * (SELECT max(r) + 1 FROM g))) AS y FROM customer),
h AS (SELECT b, g.r, g.c, nth, pow((g.c + 0.5) * 10 - x, 2) + pow(-(g.r + 0.5) * 10 - y, 2) AS d FROM q JOIN p ON p.k = q.k JOIN g ON g.k = p.place)
SELECT b AS fid, r, c, nth, round(sqrt(d), 9) AS distance FROM h QUALIFY row_number() OVER (PARTITION BY b ORDER BY d, nth) = 1""")
def descend_to_target(spark, sf):
    """For each customer, the cell nearest to a point on the way down from a cell."""
    cells = X.grid(spark, sf, _PITS).select("r", "c", "z", "k", "h")
    size = cells.agg(F.count("*").alias("n"), F.max("h").alias("height"))  # one row
    k = F.col("c_custkey")
    at = table(spark, sf, "customer").crossJoin(F.broadcast(size)).select(k.alias("key"), (k * 53 % F.col("n")).alias("k"), (k * 29 % 500).cast("double").alias("x"), (0 - k * 31 % (10 * F.col("height"))).cast("double").alias("y"))
    starts = at.join(cells.select("k", "r", "c"), "k").drop("k")
    found = drainage.descended(drainage.drained(cells.select("r", "c", "z"), TILE), starts, 10.0)
    return found.select(F.col("key").alias("fid"), "r", "c", "nth", F.round("distance", 9).alias("distance"))


def _rings(masks: str, rounds: int = 17) -> str:
    """Rings of masks (key, r, c): edges (v), their followers (u), and by doubled pointers each one's ring (l), its smallest edge."""
    out = f"""k0 AS MATERIALIZED ({masks}),
v AS MATERIALIZED (SELECT key, a.r + br AS r, a.c + bc AS c, dr, dc FROM k0 a, (VALUES (-1, 0, 0, 1, 0, -1), (1, 0, 1, 0, 0, 1), (0, -1, 0, 0, 1, 0), (0, 1, 1, 1, -1, 0)) s(nr, nc, br, bc, dr, dc)
  WHERE NOT EXISTS (SELECT 1 FROM k0 b WHERE b.key = a.key AND b.r = a.r + nr AND b.c = a.c + nc)),
vn AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY key, r, c, dr, dc) AS i FROM v),
u AS MATERIALIZED (SELECT a.i, b.i AS nxt, (a.dr <> b.dr OR a.dc <> b.dc) AS turns FROM vn a JOIN vn b ON b.key = a.key AND b.r = a.r + a.dr AND b.c = a.c + a.dc
  QUALIFY row_number() OVER (PARTITION BY a.i ORDER BY CASE WHEN b.dr = a.dc AND b.dc = -a.dr THEN 0 ELSE 1 END) = 1),
l0 AS MATERIALIZED (SELECT i, nxt, least(i, nxt) AS low FROM u)"""
    for n in range(rounds):
        out += f",\nl{n + 1} AS MATERIALIZED (SELECT a.i, b.nxt, least(a.low, b.low) AS low FROM l{n} a JOIN l{n} b ON b.i = a.nxt)"
    return out + f""",
rg AS MATERIALIZED (SELECT vn.key, low, sum(CAST(turns AS BIGINT)) AS corners, sum(-(c * (r + dr) - (c + dc) * r)) AS a2, count(*) AS n FROM vn JOIN l{rounds} USING (i) JOIN u USING (i) GROUP BY 1, 2)"""


_MASKS = f"SELECT CASE WHEN z >= 14 THEN 1 ELSE 2 END AS key, r, c FROM {_PITSQL} WHERE z >= 14 OR z < 9"


@query(f"""WITH {_rings(_MASKS)}
SELECT rg.key, r, c, CAST(corners AS BIGINT) AS corners, CAST(abs(a2) * 50.0 AS DOUBLE) AS area, CAST(n * 10.0 AS DOUBLE) AS perimeter, a2 < 0 AS hole FROM rg JOIN vn ON vn.i = low""")
def mask_outline(spark, sf):
    """All rings around the high and the low cells of the pitted grid."""
    z = F.col("z")
    masks = _pitted(spark, sf).where((z >= 14) | (z < 9)).select(F.when(z >= 14, 1).otherwise(2).alias("key"), "r", "c")
    out = outlines.measures(outlines.rings(masks), 10.0)
    return out.select("key", "ring.r", "ring.c", "corners", "area", "perimeter", "hole")


_LINES = "(SELECT c_nationkey AS ring, CAST(c_custkey AS BIGINT) AS nth, CAST(c_custkey * 3 AS DOUBLE) AS x, CAST(c_custkey * 29 % 211 AS DOUBLE) AS y FROM customer)"


@query(f"""WITH RECURSIVE pts AS MATERIALIZED {_LINES},
seg(ring, i, j, lvl) AS (SELECT ring, min(nth), max(nth), 0 FROM pts GROUP BY 1 UNION ALL
  SELECT ring, unnest([i, k]), unnest([k, j]), lvl + 1 FROM (SELECT s.ring, s.i, s.j, s.lvl, max(d) AS d, arg_max(nth, {{'d': d, 't': -nth}}) AS k FROM (
    SELECT s.ring, s.i, s.j, s.lvl, o.nth, abs((b.x - a.x) * (o.y - a.y) - (b.y - a.y) * (o.x - a.x)) / sqrt(pow(b.x - a.x, 2) + pow(b.y - a.y, 2)) AS d
    FROM seg s JOIN pts a ON a.ring = s.ring AND a.nth = s.i JOIN pts b ON b.ring = s.ring AND b.nth = s.j JOIN pts o ON o.ring = s.ring AND o.nth > s.i AND o.nth < s.j) s GROUP BY 1, 2, 3, 4) WHERE d > 47.3)
SELECT DISTINCT ring, nth FROM (SELECT ring, i AS nth FROM seg UNION ALL SELECT ring, j FROM seg)""")
def simplified_rings(spark, sf):
    """The points that Douglas and Peucker's rule keeps of each nation's line of customers."""
    return outlines.thinned(_lines(spark, sf), 47.3).select("ring", "nth")


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select(F.col("c_nationkey").alias("ring"), k.cast("long").alias("nth"), (k * 3).cast("double").alias("x"), (k * 29 % 211).cast("double").alias("y"))


@query(f"""WITH pts AS {_LINES}, c AS (SELECT * FROM pts UNION ALL SELECT ring, max(nth) + 1, arg_min(x, nth), arg_min(y, nth) FROM pts GROUP BY 1),
l AS (SELECT ring, nth, x, y, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM c WINDOW w AS (PARTITION BY ring ORDER BY nth)),
s AS (SELECT ring, 2 * nth AS nth, x + 0.25 * (nx - x) AS x, y + 0.25 * (ny - y) AS y FROM l WHERE nx IS NOT NULL UNION ALL SELECT ring, 2 * nth + 1, nx + 0.25 * (x - nx), ny + 0.25 * (y - ny) FROM l WHERE nx IS NOT NULL),
k AS (SELECT * FROM s UNION ALL SELECT ring, max(nth) + 1, arg_min(x, nth), arg_min(y, nth) FROM s GROUP BY 1),
e AS (SELECT ring, x, y, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM k WINDOW w AS (PARTITION BY ring ORDER BY nth))
SELECT ring, count(*) AS n, round(abs(sum(x * ny - nx * y)) / 2, 4) AS area, round(sum(sqrt(pow(nx - x, 2) + pow(ny - y, 2))), 4) AS perimeter FROM e GROUP BY 1""")
def smoothed_rings(spark, sf):
    """Corner cutting of each nation's line, closed."""
    rows = _lines(spark, sf)
    close = rows.groupBy("ring").agg((F.max("nth") + 1).alias("nth"), F.min_by("x", "nth").alias("x"), F.min_by("y", "nth").alias("y"))
    out = outlines.areas(outlines.smoothed(rows.unionByName(close)))
    return out.select("ring", "n", F.round("area", 4).alias("area"), F.round("perimeter", 4).alias("perimeter"))


_NEAR = "(SELECT b.k AS fid, x0, y0, CASE WHEN k % 2 = 0 THEN x0 + 5.0 * p_size ELSE x0 END AS x1, CASE WHEN k % 2 = 0 THEN y0 ELSE y0 + 5.0 * p_size END AS y1 FROM " + X.SQL_PART + " b WHERE k % 29 = 0)"


@query(f"""WITH d AS (SELECT c.k AS b, fid, pow(greatest(x0 - c.x, 0, c.x - x1), 2) + pow(greatest(y0 - c.y, 0, c.y - y1), 2) AS d FROM {X.SQL_CUSTOMER} c, {_NEAR} s)
SELECT b AS basin_id, fid AS id, round(sqrt(d), 9) AS distance FROM d WHERE d <= 2500 QUALIFY row_number() OVER (PARTITION BY b ORDER BY d, fid) = 1""")
def nearest_reach(spark, sf):
    """The reach within 50 m nearest to each outlet; outlets between 50 and 500 m off have none."""
    reaches = X.segments(spark, sf).where("fid % 29 = 0").withColumns({"id": F.col("fid"), "ord": F.col("fid")})
    outlets = X.points(spark, sf, "customer").select(F.col("key").alias("basin_id"), "x", "y")
    return basin.nearest_reach(outlets, reaches).select("basin_id", "id", F.round("distance", 9).alias("distance"))


_AROUND = f"""q0 AS (SELECT b * 10 + n AS b, ox + dc * 10 AS ox, oy - dr * 10 AS oy, least FROM (SELECT n_nationkey AS b, n_nationkey * 53 % 500 + 5.0 AS ox, -(n_nationkey * 29 % (10 * (SELECT max(r) + 1 FROM g)) + 5.0) AS oy, n_nationkey % 3 * 15 AS least FROM nation),
  (SELECT code AS n, dr, dc FROM m UNION ALL SELECT 0, 0, 0))"""
_OWN = """own AS MATERIALIZED (SELECT b // 10 AS b, r, c, tier, rung, k, abs(acc) AS n FROM snap WHERE b % 10 = 0),
near AS MATERIALIZED (SELECT b // 10 AS b, k, abs(acc) AS n FROM snap WHERE b % 10 > 0),
st AS MATERIALIZED (SELECT own.b, min(CASE WHEN EXISTS (SELECT 1 FROM p WHERE (p.k = own.k AND p.place = near.k) OR (p.k = near.k AND p.place = own.k)) THEN least(own.n, near.n) / greatest(own.n, near.n)::DOUBLE ELSE 0 END) AS stability FROM own JOIN near USING (b) WHERE near.n >= 20 GROUP BY 1)"""


@query(f"""WITH RECURSIVE {_snaps(f'{_ways(_PITSQL, 25)}, {_AROUND}')}, {_OWN}, {_rings('SELECT own.b AS key, g.r, g.c FROM own JOIN p ON p.place = own.k JOIN g ON g.k = p.k', 13)},
big AS (SELECT key, a2 * 50.0 AS area, n * 10.0 AS perimeter FROM rg WHERE a2 > 0 QUALIFY row_number() OVER (PARTITION BY key ORDER BY a2 DESC, low) = 1)
SELECT own.b AS basin_id, r, c, tier, rung, own.n AS cells, area, perimeter, round(stability, 9) AS stability,
  CASE WHEN area < 50 * own.n THEN 'too small a part of what drains there' WHEN area < 2000 THEN 'degenerate basin' WHEN stability < 0.5 THEN 'unstable outlet' END AS refusal
FROM own LEFT JOIN st USING (b) LEFT JOIN big ON big.key = own.b""")
def delineate_outlets(spark, sf):
    """Basins of one outlet a nation on one pitted grid: snap, size, outline, stability and refusal."""
    k = F.col("n_nationkey")
    height = X.grid(spark, sf, "0").agg(F.max("h").alias("height"))  # one row
    rows = table(spark, sf, "nation").crossJoin(F.broadcast(height))
    outlets = rows.select(k.cast("long").alias("key"), (k * 53 % 500 + 5.0).cast("double").alias("ox"), (-(k * 29 % (10 * F.col("height")) + 5.0)).cast("double").alias("oy"), (k % 3 * 15).cast("double").alias("least"))
    out = drainage.delineated(_pitted(spark, sf), outlets, 10.0, 20, size=TILE)
    return out.withColumnRenamed("key", "basin_id").withColumn("stability", F.round("stability", 9))


# waves of tiles over a drawn tree: node k stands in row log2(k + 1), the rows 100 m apart and 1024 m wide

_SIDE = 128.0
_NODE = "SELECT k, 1024 * (k + 1.5 - pow(2, lev)) / pow(2, lev) AS x, lev * 100.0 AS y FROM (SELECT c_custkey AS k, length(bin(c_custkey + 1)) - 1 AS lev FROM customer)"


def _waves_sql(n: int = 14) -> str:
    """One wave after the other: tiles (l), known reaches (k), the network found in them (c), and the nodes where it ends (d)."""
    steps = f"""t AS MATERIALIZED {Q._TREE}, nd AS MATERIALIZED ({_NODE}),
i AS MATERIALIZED ({Q._INFLOW.replace(Q._TREE, 't')}), h AS MATERIALIZED ({Q._HEAD.replace(Q._TREE, 't')}),
s AS MATERIALIZED (SELECT h.id, i.id AS up FROM h JOIN i USING (node) WHERE h.id <> i.id),
e AS MATERIALIZED (SELECT t.*, a.x AS ax, a.y AS ay, b.x AS qx, b.y AS qy FROM t JOIN nd a ON a.k = t.id JOIN nd b ON b.k = t.parent),
rt AS MATERIALIZED (SELECT DISTINCT id, tx, unnest(range(CAST(floor(least(ay, qy) / {_SIDE}) AS BIGINT), CAST(floor(greatest(ay, qy) / {_SIDE}) AS BIGINT) + 1)) AS ty FROM
  (SELECT *, unnest(range(CAST(floor(least(ax, qx) / {_SIDE}) AS BIGINT), CAST(floor(greatest(ax, qx) / {_SIDE}) AS BIGINT) + 1)) AS tx FROM e)),
q AS MATERIALIZED (SELECT n_nationkey AS b, id, (ax + qx) / 2 AS x, (ay + qy) / 2 AS y FROM nation JOIN e ON e.id = 1 + n_nationkey * 7 % 60),
l0 AS MATERIALIZED (SELECT b, tx, unnest(range(CAST(floor((y - 50) / {_SIDE}) AS BIGINT), CAST(floor((y + 50) / {_SIDE}) AS BIGINT) + 1)) AS ty FROM (SELECT *, unnest(range(CAST(floor((x - 50) / {_SIDE}) AS BIGINT), CAST(floor((x + 50) / {_SIDE}) AS BIGINT) + 1)) AS tx FROM q))"""
    for w in range(n):
        steps += f""",
k{w} AS MATERIALIZED (SELECT DISTINCT b, id FROM l{w} JOIN rt USING (tx, ty)),
c{w} AS (SELECT b, id FROM q UNION SELECT c.b, s.up FROM c{w} c JOIN s ON s.id = c.id JOIN k{w} k ON k.b = c.b AND k.id = s.up),
d{w} AS MATERIALIZED (SELECT c.b, e.ax, e.ay FROM c{w} c JOIN e ON e.id = c.id WHERE oriented AND NOT EXISTS (SELECT 1 FROM i JOIN k{w} k ON k.id = i.id WHERE k.b = c.b AND i.node = e.id AND i.id <> e.id)),
l{w + 1} AS MATERIALIZED (SELECT b, tx, ty FROM l{w} UNION SELECT b, CAST(floor((ax + dx) / {_SIDE}) AS BIGINT), CAST(floor((ay + dy) / {_SIDE}) AS BIGINT) FROM d{w}, (SELECT unnest([-1, 1]) AS dx), (SELECT unnest([-1, 1]) AS dy))"""
    w = n - 1
    return f"""WITH RECURSIVE {steps}
SELECT q.b AS basin_id, (SELECT count(*) FROM c{w} c WHERE c.b = q.b) AS n_reaches, (SELECT count(*) FROM l{n} l WHERE l.b = q.b) AS tiles, (SELECT count(*) FROM k{w} k WHERE k.b = q.b) AS loaded FROM q"""


def _drawn(spark: SparkSession, sf: str) -> DataFrame:
    """The tree's reaches as lines between their nodes."""
    k = F.col("c_custkey")
    lev = F.length(F.bin(k + 1)) - 1
    node = table(spark, sf, "customer").select(k.alias("k"), (1024 * (k + 1.5 - F.pow(F.lit(2.0), lev)) / F.pow(F.lit(2.0), lev)).alias("x"), (lev * 100.0).alias("y"))
    tree = X.tree(spark, sf)
    ends = tree
    for end, n in (("ini", "ini"), ("fin", "fin")):
        ends = ends.join(node.select(F.col("k").cast("string").alias(end), F.col("x").alias(f"x_{n}"), F.col("y").alias(f"y_{n}")), end)
    box = {"xmin": F.least("x_ini", "x_fin"), "ymin": F.least("y_ini", "y_fin"), "xmax": F.greatest("x_ini", "x_fin"), "ymax": F.greatest("y_ini", "y_fin")}
    return ends.withColumns(box).withColumn("geom", spatial.segment_wkb(F.col("x_ini"), F.col("y_ini"), F.col("x_fin"), F.col("y_fin")))


@query(_waves_sql())
def upstream_waves(spark, sf):
    """The network above one outlet a nation, with the tiles and reaches that had to be read for it."""
    reaches = _drawn(spark, sf)
    folder = f"{Rounds(spark, 'tiled').base}/reaches"
    waves.store(reaches, folder, _SIDE)
    read = waves.stored(spark, folder)
    at = table(spark, sf, "nation").select(F.col("n_nationkey").alias("basin_id"), (1 + F.col("n_nationkey") * 7 % 60).cast("long").alias("id"))
    outlets = at.join(reaches, "id").select("basin_id", ((F.col("x_ini") + F.col("x_fin")) / 2).alias("x"), ((F.col("y_ini") + F.col("y_fin")) / 2).alias("y"))
    return waves.extend(waves.start(outlets, read, _SIDE), read, _SIDE, budget=None).drop("refusal")


_LON, _LAT = "-5 + c_custkey * 37 % 1400 / 100.0", "41.3 + c_custkey * 53 % 980 / 100.0"
_P = {n: repr(float(getattr(projection, f"_{n}"))) for n in ("E", "N", "C", "R0", "X0", "Y0", "LON0")}


@query(f"""WITH p AS (SELECT c_custkey AS fid, CAST({_LON} AS DOUBLE) AS lon, CAST({_LAT} AS DOUBLE) AS lat FROM customer),
m AS (SELECT *, {_P['C']} * pow(tan(pi() / 4 - radians(lat) / 2) * exp({_P['E']} * atanh({_P['E']} * sin(radians(lat)))), {_P['N']}) AS r, {_P['N']} * (radians(lon) - {_P['LON0']}) AS a FROM p)
SELECT fid, round({_P['X0']} + r * sin(a), 3) AS x, round({_P['Y0']} + {_P['R0']} - r * cos(a), 3) AS y, round(lon, 8) AS lon, round(lat, 8) AS lat FROM m""")
def lambert93_round_trip(spark, sf):
    """Places to metres and back again, all in built-in functions; a hundred-millionth of a degree is about a millimetre."""
    places = table(spark, sf, "customer").select(F.col("c_custkey").alias("fid"), F.expr(_LON).cast("double").alias("lon"), F.expr(_LAT).cast("double").alias("lat"))
    there = places.withColumn("p", projection.lambert93("lon", "lat"))
    back = there.withColumn("b", projection.wgs84("p.x", "p.y"))
    return back.select("fid", F.round("p.x", 3).alias("x"), F.round("p.y", 3).alias("y"), F.round("b.x", 8).alias("lon"), F.round("b.y", 8).alias("lat"))
