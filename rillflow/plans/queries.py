"""One query for each operator of the survey over the plain tables, with the SQL that states its result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rillflow.functions import scalar as S
from rillflow.operators import aggregates as A
from rillflow.operators import graph, reshape, spatial, windows
from rillflow.plans import elevation, report
from rillflow.plans import shapes as X
from rillflow.plans import themes as T
from rillflow.sources import layers
from rillflow.sources.layers import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return keep


# sources and sets


@query("SELECT k AS fid, p_brand, x0 AS xmin, y0 AS ymin FROM " + X.SQL_PART + " WHERE x0 <= 500 AND x1 >= 200 AND y0 <= 500 AND y1 >= 200")
def bbox_scan(spark, sf):
    return layers.scan(X.boxes(spark, sf, geom=False), (200.0, 200.0, 500.0, 500.0), columns=["fid", "p_brand", "xmin", "ymin"])


@query("SELECT count(*) AS n_rows, CAST(10000 AS BIGINT) AS budget, count(*) > 10000 AS over FROM orders")
def scan_budget_guard(spark, sf):
    return layers.over_budget(table(spark, sf, "orders").select(F.lit(1).alias("one")), 10_000)


@query("SELECT s_suppkey AS fid, s_name AS name, 'supplier' AS layer FROM supplier UNION ALL SELECT c_custkey, c_name, 'customer' FROM customer")
def multi_layer_union(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("fid"), F.col("s_name").alias("name"))
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("fid"), F.col("c_name").alias("name"))
    return layers.union_layers({"supplier": s, "customer": c})


@query("""
WITH a AS (SELECT k AS id, 'a' AS origin FROM (SELECT CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_partkey % 700 END AS k FROM part) WHERE k IS NOT NULL GROUP BY k)
SELECT id, 'known' AS origin FROM a
UNION ALL SELECT NULL, 'known' FROM part WHERE p_partkey % 5 = 0
UNION ALL SELECT s_suppkey + 600, 'new' FROM supplier WHERE s_suppkey + 600 NOT IN (SELECT id FROM a)
""")
def insert_if_new(spark, sf):
    k = F.when(F.col("p_partkey") % 5 != 0, F.col("p_partkey") % 700)
    known = table(spark, sf, "part").select(k.alias("id"), F.col("p_partkey").alias("ord"), F.lit("known").alias("origin"))
    new = table(spark, sf, "supplier").select((F.col("s_suppkey") + 600).alias("id"), F.col("s_suppkey").alias("ord"), F.lit("new").alias("origin"))
    return graph.merged(known, new).select("id", "origin")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'FURNITURE')")
def restrict_by_codes(spark, sf):
    codes = table(spark, sf, "customer").where("c_mktsegment = 'FURNITURE'").select(F.col("c_custkey").alias("o_custkey"))
    return layers.by_codes(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), codes, "o_custkey")


@query("""
SELECT 'casias' AS inventory, CAST(s_suppkey AS VARCHAR) AS code, nullif(trim(s_name), '') AS name, CAST(NULL AS BIGINT) AS area FROM supplier
UNION ALL SELECT 'instruction', CAST(c_custkey AS VARCHAR), nullif(trim(c_mktsegment), ''), NULL FROM customer
UNION ALL SELECT 'sis', CAST(p_partkey AS VARCHAR), nullif(trim(p_name), ''), CAST(p_size * (1 + p_partkey % 20) AS BIGINT) FROM part
""")
def schema_harmonise(spark, sf):
    none = F.lit(None).cast("long")
    return layers.union_layers(
        {
            "casias": layers.harmonised(table(spark, sf, "supplier"), code="s_suppkey", name="s_name", area=none),
            "instruction": layers.harmonised(table(spark, sf, "customer"), code="c_custkey", name="c_mktsegment", area=none),
            "sis": layers.harmonised(table(spark, sf, "part"), code="p_partkey", name="p_name", area=(F.col("p_size") * (1 + F.col("p_partkey") % 20)).cast("long")),
        },
        "inventory",
    )


@query("""
SELECT r_regionkey, array_to_string(list_sort(list_intersect(w, ['a0', 'a1', 'b2', 'c3'])), ',') AS known,
  array_to_string(list_sort(list_filter(w, lambda x: NOT list_contains(['a0', 'a1', 'b2', 'c3'], x))), ',') AS unknown,
  array_to_string(list_sort(list_distinct(list_concat(w, ['a0']))), ',') AS with_default
FROM (SELECT r_regionkey, ['a' || r_regionkey, 'b' || (r_regionkey % 3), 'z' || r_regionkey] AS w FROM region)
""")
def selection_algebra(spark, sf):
    k, all_known = F.col("r_regionkey"), F.array(*map(F.lit, ["a0", "a1", "b2", "c3"]))
    wanted = F.array(F.concat(F.lit("a"), k.cast("string")), F.concat(F.lit("b"), (k % 3).cast("string")), F.concat(F.lit("z"), k.cast("string")))
    text = lambda a: F.array_join(F.sort_array(a), ",")
    rows = table(spark, sf, "region").select("r_regionkey", wanted.alias("w"))
    return rows.select(
        "r_regionkey", text(F.array_intersect("w", all_known)).alias("known"), text(F.array_except("w", all_known)).alias("unknown"), text(F.array_union("w", F.array(F.lit("a0")))).alias("with_default")
    )


_TILES = "SELECT DISTINCT CAST(floor(x / 100) AS BIGINT) AS tx, CAST(floor(y / 100) AS BIGINT) AS ty FROM "


@query(f"""
WITH t AS ({_TILES}{X.SQL_SUPPLIER}), r AS (SELECT ty, tx, tx - row_number() OVER (PARTITION BY ty ORDER BY tx) AS g FROM t)
SELECT ty, min(tx) AS first, max(tx) AS last, count(*) AS n FROM r GROUP BY ty, g
""")
def tile_islands(spark, sf):
    p = X.points(spark, sf, "supplier").select(S.tile("x", 100).alias("tx"), S.tile("y", 100).alias("ty"))
    return windows.runs(p, "ty", "tx")


@query(f"""
WITH a AS ({_TILES}{X.SQL_SUPPLIER}), b AS ({_TILES}{X.SQL_CUSTOMER} WHERE k % 3 = 0)
SELECT tx, ty, 'both' AS side FROM (SELECT * FROM a INTERSECT SELECT * FROM b)
UNION ALL SELECT tx, ty, 'first' FROM (SELECT * FROM a EXCEPT SELECT * FROM b)
UNION ALL SELECT tx, ty, 'second' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)
""")
def tile_sets(spark, sf):
    tiles = lambda df: df.select(S.tile("x", 100).alias("tx"), S.tile("y", 100).alias("ty"))
    a = tiles(X.points(spark, sf, "supplier")).withColumn("m", F.lit(1))
    b = tiles(X.points(spark, sf, "customer").where("key % 3 = 0")).withColumn("m", F.lit(2))
    both = a.unionByName(b).groupBy("tx", "ty").agg(F.bit_or("m").alias("m"))
    return both.select("tx", "ty", F.element_at(F.array(F.lit("first"), F.lit("second"), F.lit("both")), F.col("m")).alias("side"))


# predicates and projections


@query("SELECT conv_id, turn, left(coalesce(nullif(trim(text), ''), nullif(trim(role), ''), 'non renseigné'), 40) AS label FROM conversations")
def first_nonempty(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", F.left(S.first_nonempty("text", "role", default="non renseigné"), F.lit(40)).alias("label"))


@query("""
WITH e AS (SELECT event_id, json_extract_string(props, '$.k') AS k FROM events),
f AS (SELECT event_id, CASE WHEN event_id % 4 = 0 THEN k || 'x' WHEN event_id % 4 = 1 THEN ' ' || k || '.5 ' ELSE k END AS t,
  CASE event_id % 6 WHEN 0 THEN 'Oui' WHEN 1 THEN ' non ' WHEN 2 THEN '1' WHEN 3 THEN 'FALSE' WHEN 4 THEN '?' END AS b FROM e)
SELECT event_id, try_cast(trim(t) AS DOUBLE) AS number,
  CASE WHEN lower(trim(b)) IN ('1','true','oui','o','yes','y') THEN true WHEN lower(trim(b)) IN ('0','false','non','n','no') THEN false END AS flag FROM f
""")
def safe_casts(spark, sf):
    n, k = F.col("event_id"), F.get_json_object("props", "$.k")
    text = F.when(n % 4 == 0, F.concat(k, F.lit("x"))).when(n % 4 == 1, F.concat(F.lit(" "), k, F.lit(".5 "))).otherwise(k)
    word = F.get(F.array(*map(F.lit, ["Oui", " non ", "1", "FALSE", "?", None])), (n % 6).cast("int"))
    return table(spark, sf, "events").select("event_id", S.as_float(text).alias("number"), S.as_bool(word).alias("flag"))


_HEIGHT = """SELECT p_partkey AS k, CASE WHEN p_partkey % 5 = 0 THEN CAST(p_size AS VARCHAR) WHEN p_partkey % 5 = 1 THEN '0' ELSE '' END AS exact,
  CASE p_partkey % 4 WHEN 0 THEN 'De ' || p_size || ',5 à ' || (p_size + 3) || ' m' WHEN 1 THEN 'Supérieure à ' || p_size || 'm' WHEN 2 THEN 'Indéterminée' ELSE '' END AS label FROM part"""


@query(f"""
WITH h AS ({_HEIGHT}), n AS (SELECT k, try_cast(nullif(exact, '') AS DOUBLE) AS e, list_transform(regexp_extract_all(label, '[0-9]+(?:[.,][0-9]+)?'), lambda x: CAST(replace(x, ',', '.') AS DOUBLE)) AS b FROM h)
SELECT k AS fid, CASE WHEN e > 0 THEN e WHEN len(b) >= 2 THEN (b[1] + b[2]) / 2 WHEN len(b) = 1 THEN b[1] END AS height, CASE WHEN e > 0 THEN 'mesuree' WHEN len(b) >= 1 THEN 'classe' END AS origin FROM n
""")
def height_from_text(spark, sf):
    df = table(spark, sf, "part").selectExpr(
        "p_partkey AS fid",
        "CASE WHEN p_partkey % 5 = 0 THEN CAST(p_size AS STRING) WHEN p_partkey % 5 = 1 THEN '0' ELSE '' END AS exact",
        "CASE p_partkey % 4 WHEN 0 THEN concat('De ', p_size, ',5 à ', p_size + 3, ' m') WHEN 1 THEN concat('Supérieure à ', p_size, 'm') WHEN 2 THEN 'Indéterminée' ELSE '' END AS label",
    )
    height, origin = S.height_from_text("exact", "label")
    return df.select("fid", height.alias("height"), origin.alias("origin"))


def _norm_sql() -> str:
    out = []
    for name, t in S.LIMITS.items():
        for k, unit in enumerate(("mg_l", "rdt_pct")):
            null = lambda v: "NULL" if v is None else f"CAST({v} AS DOUBLE)"
            if "small" in t:
                out.append(f"CASE WHEN cap >= 2000 THEN {null(t['large'][k])} WHEN cap IS NOT NULL THEN {null(t['small'][k])} END AS norme_{name}_{unit}")
            else:
                out.append(f"CASE WHEN zone AND cap > 100000 THEN {null(t['high'][k])} WHEN zone AND cap > 10000 THEN {null(t['medium'][k])} END AS norme_{name}_{unit}")
    return ", ".join(out)


@query(f"""
WITH s AS (SELECT s_suppkey, CAST(round(s_acctbal * 15) AS BIGINT) AS c, s_nationkey % 3 AS m, CAST(round(s_acctbal * 9) AS BIGINT) AS load FROM supplier),
p AS (SELECT s_suppkey, CASE WHEN c > 0 THEN CAST(c AS DOUBLE) END AS cap, CASE m WHEN 0 THEN NULL WHEN 1 THEN false ELSE true END AS zone, CAST(load AS DOUBLE) AS load FROM s)
SELECT s_suppkey, cap, zone, {_norm_sql()}, CASE WHEN cap >= 2000 THEN '≥ 2 000 EH' WHEN cap IS NOT NULL THEN '< 2 000 EH' END AS norme_classe,
  round(CASE WHEN load > 0 AND cap <> 0 THEN 100 * load / cap END, 6) AS load_pct,
  CASE WHEN cap IS NULL THEN 'Capacité non renseignée' WHEN cap < 2000 THEN '< 2 000 EH' WHEN cap < 10000 THEN '2 000 à 9 999 EH' ELSE '≥ 10 000 EH' END AS class FROM p
""")
def discharge_norms(spark, sf):
    code = F.get(F.array(F.lit(""), F.lit("FRHZS_00000"), F.lit("ZS01")), F.col("s_nationkey") % 3)
    df = table(spark, sf, "supplier").select(
        "s_suppkey", S.capacity(F.round(F.col("s_acctbal") * 15).cast("long")).alias("cap"), S.sensitive_zone(code).alias("zone"), F.round(F.col("s_acctbal") * 9).cast("double").alias("load")
    )
    norms = [c.alias(n) for n, c in S.discharge_norms("cap", "zone").items()]
    return df.select("s_suppkey", "cap", "zone", *norms, F.round(S.load_rate("cap", "load"), 6).alias("load_pct"), S.capacity_class("cap").alias("class"))


_CROP = "CASE p_partkey % 6 WHEN 0 THEN 'Prairie ' || p_name WHEN 1 THEN 'SURFACE PASTORALE' WHEN 2 THEN 'Blé tendre' WHEN 3 THEN '' ELSE p_name END"


@query(f"""
SELECT p_partkey AS fid, CASE WHEN coalesce(l, '') <> '' THEN strip_accents(lower(l)) LIKE '%prairie%' OR strip_accents(lower(l)) LIKE '%surface pastorale%' ELSE cat = 'PP' END AS grass
FROM (SELECT p_partkey, {_CROP} AS l, CASE WHEN p_partkey % 9 = 3 THEN 'PP' ELSE 'TA' END AS cat FROM part)
""")
def keyword_grass(spark, sf):
    df = table(spark, sf, "part").selectExpr("p_partkey AS fid", f"{_CROP} AS label", "CASE WHEN p_partkey % 9 = 3 THEN 'PP' ELSE 'TA' END AS cat")
    return df.select("fid", S.is_grass("label", "cat").alias("grass"))


@query(f"SELECT doc_id, md5(translate(lower(coalesce(text, '')), '{S._ACCENTED}', '{S._PLAIN}')) AS folded FROM documents")
def accent_fold(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(S.fold("text").cast("binary")).alias("folded"))


@query(f"""
SELECT k AS fid, CASE len(s) WHEN 0 THEN NULL WHEN 1 THEN s[1] ELSE array_to_string(s[1:-2], ', ') || ' et ' || s[-1] END AS sides
FROM (SELECT k, list_filter([CASE WHEN x0 < 40 THEN 'l''ouest' END, CASE WHEN y0 < 40 THEN 'le sud' END, CASE WHEN 1000 - x1 < 40 THEN 'l''est' END, CASE WHEN 1000 - y1 < 40 THEN 'le nord' END], lambda x: x IS NOT NULL) AS s FROM {X.SQL_PART})
""")
def edge_sides(spark, sf):
    return X.boxes(spark, sf, geom=False).select("fid", S.sides(*spatial.BOX, (0, 0, 1000, 1000), 40).alias("sides"))


@query(f"""
SELECT k AS fid, CASE WHEN p_size * 1000 / 5.0 * (1000 * (1 + k % 20) / 5.0) <= 2e6 THEN 5.0 WHEN p_size * 1000 / 10.0 * (1000 * (1 + k % 20) / 10.0) <= 2e6 THEN 10.0
  WHEN p_size * 1000 / 25.0 * (1000 * (1 + k % 20) / 25.0) <= 2e6 THEN 25.0 ELSE 50.0 END::DOUBLE AS resolution,
  CAST(floor(x0 / 25) * 25 AS DOUBLE) AS sx0, CAST(ceil(y1 / 25) * 25 AS DOUBLE) AS sy1, CAST(round((ceil(x1 / 25) * 25 - floor(x0 / 25) * 25) / 25) AS BIGINT) AS width FROM {X.SQL_PART}
""")
def choose_resolution(spark, sf):
    b = X.boxes(spark, sf, geom=False)
    snap = S.snap_extent(*spatial.BOX, F.lit(25.0))
    w, h = F.col("p_size") * 1000.0, (F.col("ymax") - F.col("ymin")) * 1000
    return b.select("fid", S.choose_resolution(w, h, F.lit(2e6)).alias("resolution"), snap["x0"].cast("double").alias("sx0"), snap["y1"].cast("double").alias("sy1"), snap["width"].alias("width"))


@query(f"""
WITH m AS (SELECT k, (x1 - x0) * (y1 - y0) AS a, 2 * (x1 - x0 + y1 - y0) AS p FROM {X.SQL_PART}), g AS (SELECT *, 0.28 * p / sqrt(a) AS g FROM m),
l AS (SELECT *, CASE WHEN 1.128 / g >= 1 THEN sqrt(a) ELSE g * sqrt(a) / 1.128 * (1 + sqrt(1 - (1.128 / g) * (1.128 / g))) END AS l FROM g)
SELECT k AS fid, round(g, 6) AS gravelius, round(l, 6) AS rect_length, round(CASE WHEN 1.128 / g >= 1 THEN l ELSE a / l END, 6) AS rect_width FROM l
""")
def shape_metrics(spark, sf):
    m = X.boxes(spark, sf, geom=False).withColumns({"a": (F.col("xmax") - F.col("xmin")) * (F.col("ymax") - F.col("ymin")), "p": 2 * (F.col("xmax") - F.col("xmin") + F.col("ymax") - F.col("ymin"))})
    length, width = S.equivalent_rectangle("a", "p")
    return m.select("fid", F.round(S.gravelius("a", "p"), 6).alias("gravelius"), F.round(length, 6).alias("rect_length"), F.round(width, 6).alias("rect_width"))


_NAME = "p_name || CASE p_partkey % 4 WHEN 0 THEN ' (lot ' || p_partkey || ')' WHEN 1 THEN ' - ' || p_brand WHEN 2 THEN ', ' || p_type ELSE ' sans separateur ' || p_brand END"


@query(f"""
WITH n AS (SELECT DISTINCT {_NAME} AS name FROM part),
s AS (SELECT name, CASE WHEN length(name) <= 20 THEN name WHEN instr(name, ' (') - 1 BETWEEN 1 AND 20 THEN left(name, instr(name, ' (') - 1) WHEN instr(name, ' - ') - 1 BETWEEN 1 AND 20 THEN left(name, instr(name, ' - ') - 1)
  WHEN instr(name, ', ') - 1 BETWEEN 1 AND 20 THEN left(name, instr(name, ', ') - 1) ELSE rtrim(left(name, 19)) || '…' END AS short FROM n),
c AS (SELECT *, count(*) OVER (PARTITION BY short) AS n FROM s)
SELECT name, CASE WHEN n > 1 AND name <> short THEN CASE WHEN length(name) > 20 THEN rtrim(left(name, 19)) || '…' ELSE name END ELSE short END AS label FROM c
""")
def label_shorten_unique(spark, sf):
    df = table(spark, sf, "part").selectExpr(f"{_NAME} AS name").distinct().withColumn("short", S.short_label("name", 20))
    clash = (F.count("*").over(Window.partitionBy("short")) > 1) & (F.col("name") != F.col("short"))
    return df.select("name", F.when(clash, S.cut_label("name", 20)).otherwise(F.col("short")).alias("label"))


@query("""
WITH t AS (SELECT n_nationkey, CAST(sum(CAST(c_acctbal AS DECIMAL(28,4))) AS DOUBLE) AS v, count(*) AS n FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY 1)
SELECT n_nationkey, CASE WHEN abs(v) >= 1000 THEN replace(format('{:,.0f}', v), ',', ' ') ELSE format('{:.2f}', v) END AS total, CASE WHEN n > 55 THEN 'oui' ELSE 'non' END AS many, 'Total : ' || n || ' clients' AS filled FROM t
""")
def number_format_fr(spark, sf):
    t = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(A.exact_sum("c_acctbal").alias("v"), F.count("*").alias("n"))
    return t.select("n_nationkey", S.french_number("v").alias("total"), S.yes_no(F.col("n") > 55).alias("many"), S.filled("Total : {n} clients", n="n").alias("filled"))


# spatial joins


@query(f"SELECT b AS basin_id, k AS fid FROM {X.SQL_SUPPLIER} JOIN {X.SQL_BASIN} ON x BETWEEN bx0 AND bx1 AND y BETWEEN by0 AND by1")
def spatial_semi(spark, sf):
    p = X.placed(X.points(spark, sf, "supplier"))
    met = spatial.pairs(p, X.basins(spark, sf), X.TILE).where(spatial.point_in("geom", "r_geom") == 1)
    return met.select(F.col("r_basin_id").alias("basin_id"), F.col("key").alias("fid"))


@query(f"SELECT b AS basin_id, k AS fid, {X.SQL_OVERLAP} AS overlap FROM {X.SQL_PART} JOIN {X.SQL_BASIN} ON {X.SQL_MEET}")
def overlay_clip_area(spark, sf):
    met = spatial.overlay(X.boxes(spark, sf), X.basins(spark, sf), X.TILE)
    return met.select(F.col("r_basin_id").alias("basin_id"), "fid", "overlap")


_SEGMENTS = f"(SELECT k, x0, y0, CASE WHEN k % 2 = 0 THEN x0 + p_size * 5 ELSE x0 END AS x1, CASE WHEN k % 2 = 0 THEN y0 ELSE y0 + p_size * 5 END AS y1, p_size * 5.0 AS len FROM {X.SQL_PART})"
_INSIDE = "CASE WHEN greatest(x0, bx0) <= least(x1, bx1) AND greatest(y0, by0) <= least(y1, by1) THEN least(x1, bx1) - greatest(x0, bx0) + least(y1, by1) - greatest(y0, by0) ELSE 0 END"


@query(f"SELECT b AS basin_id, k AS fid, round({_INSIDE}, 6) AS inside FROM {_SEGMENTS} JOIN {X.SQL_BASIN} ON {_INSIDE} > 0")
def line_clip_length(spark, sf):
    met = spatial.lines_in(X.segments(spark, sf), X.basins(spark, sf), X.TILE).where("inside > 0")
    return met.select(F.col("r_basin_id").alias("basin_id"), "fid", F.round("inside", 6).alias("inside"))


@query(f"""
WITH p AS (SELECT c.k, b.b, greatest(bx0 - x, 0, x - bx1) AS dx, greatest(by0 - y, 0, y - by1) AS dy FROM {X.SQL_CUSTOMER} c JOIN {X.SQL_BASIN} b ON x BETWEEN bx0 - 50 AND bx1 + 50 AND y BETWEEN by0 - 50 AND by1 + 50),
d AS (SELECT *, sqrt(dx * dx + dy * dy) AS d FROM p), r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY d, b) AS n FROM d)
SELECT c.k AS fid, r.b AS basin_id, round(r.d, 6) AS distance, r.d = 0 AS exact FROM {X.SQL_CUSTOMER} c LEFT JOIN r ON r.k = c.k AND n = 1
""")
def point_in_polygon_or_nearest(spark, sf):
    p = X.placed(X.points(spark, sf, "customer")).select("key", "geom", *spatial.BOX)
    met = spatial.contained_or_nearest(p, X.basins(spark, sf), "key", "basin_id", 50.0, X.TILE)
    return met.select(F.col("key").alias("fid"), F.col("r_basin_id").alias("basin_id"), F.round("distance", 6).alias("distance"), "exact")


@query(f"""
WITH p AS (SELECT c.k, b.b, greatest(bx0 - x, 0, x - bx1) AS dx, greatest(by0 - y, 0, y - by1) AS dy FROM {X.SQL_CUSTOMER} c JOIN {X.SQL_BASIN} b ON x BETWEEN bx0 - 80 AND bx1 + 80 AND y BETWEEN by0 - 80 AND by1 + 80),
d AS (SELECT k, b, sqrt(dx * dx + dy * dy) AS d FROM p), e AS (SELECT *, min(d) OVER (PARTITION BY k) = 0 AS held FROM d WHERE d <= 80)
SELECT k AS fid, b AS basin_id, round(d, 6) AS distance, CAST(row_number() OVER (PARTITION BY k ORDER BY d, b) AS INTEGER) AS rank FROM e WHERE NOT held OR d = 0
""")
def containing_or_near(spark, sf):
    p = X.placed(X.points(spark, sf, "customer")).select("key", "geom", *spatial.BOX)
    met = spatial.containing_or_near(p, X.basins(spark, sf), "key", "basin_id", 80.0, X.TILE)
    return met.select(F.col("key").alias("fid"), F.col("r_basin_id").alias("basin_id"), F.round("distance", 6).alias("distance"), "rank")


@query(f"""
SELECT s.k AS fid, arg_min(p.k, (CASE WHEN p.k % 7 = 0 THEN 1e18 ELSE (x1 - x0) * (y1 - y0) END) * 1000000 + p.k) AS smallest, count(*) AS n
FROM {X.SQL_SUPPLIER} s JOIN {X.SQL_PART} p ON x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 GROUP BY 1
""")
def smallest_enclosing(spark, sf):
    p = X.placed(X.points(spark, sf, "supplier")).select("key", "geom", *spatial.BOX)
    met = spatial.pairs(p, X.boxes(spark, sf), X.TILE).where(spatial.point_in("geom", "r_geom") == 1)
    area = F.when(F.col("r_fid") % 7 != 0, (F.col("r_xmax") - F.col("r_xmin")) * (F.col("r_ymax") - F.col("r_ymin")))
    order = F.struct(F.coalesce(area, F.lit(float("inf"))), "r_fid")
    return met.groupBy(F.col("key").alias("fid")).agg(F.min_by("r_fid", order).alias("smallest"), F.count("*").alias("n"))


@query(f"""
WITH d AS (SELECT c.k, s.k AS s, (c.x - s.x) * (c.x - s.x) + (c.y - s.y) * (c.y - s.y) AS d2 FROM {X.SQL_CUSTOMER} c JOIN {X.SQL_SUPPLIER} s ON abs(c.x - s.x) <= 60 AND abs(c.y - s.y) <= 60)
SELECT k AS fid, arg_min(s, d2 * 10000000 + s) AS nearest, min(d2) AS d2 FROM d WHERE d2 <= 3600 GROUP BY 1
""")
def nearest_within_radius(spark, sf):
    c = X.points(spark, sf, "customer").select("key", "x", "y")
    s = X.points(spark, sf, "supplier").select("key", "x", "y")
    return spatial.nearest_points(c, s, "key", "key", 60.0).select(F.col("key").alias("fid"), F.col("r_key").alias("nearest"), "d2")


@query(f"""
WITH m AS (SELECT o_orderkey, b, row_number() OVER (PARTITION BY o_orderkey ORDER BY b) AS n FROM orders JOIN {X.SQL_CUSTOMER} c ON c.k = o_custkey JOIN {X.SQL_BASIN} ON x BETWEEN bx0 AND bx1 AND y BETWEEN by0 AND by1)
SELECT o_orderkey, b AS basin_id FROM m WHERE n = 1
""")
def first_match_assign(spark, sf):
    p = X.placed(X.points(spark, sf, "customer")).select("key", "geom", *spatial.BOX)
    met = spatial.pairs(p, X.basins(spark, sf), X.TILE).where(spatial.point_in("geom", "r_geom") == 1)
    first = spatial.first_match(met, "key", "r_basin_id").select("key", F.col("r_basin_id").alias("basin_id"))
    return table(spark, sf, "orders").join(first, F.col("o_custkey") == F.col("key")).select("o_orderkey", "basin_id")


@query(f"""
WITH d AS (SELECT b, p_brand, x0, y0, x1, y1 FROM {X.SQL_PART} JOIN {X.SQL_BASIN} ON {X.SQL_MEET}),
u AS (SELECT DISTINCT p_brand, cx, cy FROM (SELECT p_brand, y0, y1, unnest(generate_series(CAST(x0 AS BIGINT), CAST(x1 AS BIGINT) - 1)) AS cx FROM {X.SQL_PART}), LATERAL (SELECT unnest(generate_series(CAST(y0 AS BIGINT), CAST(y1 AS BIGINT) - 1)) AS cy))
SELECT p_brand, CAST(count(*) AS DOUBLE) AS area FROM u GROUP BY 1
""")
def union_area(spark, sf):
    return spatial.union_areas(X.boxes(spark, sf), ["p_brand"], 250.0)


@query(f"""
WITH s AS (SELECT d.dx, d.dy FROM (VALUES (-3, -3), (-3, 0), (-3, 3), (0, -3), (0, 3), (3, -3), (3, 0), (3, 3)) d(dx, dy)),
i AS (SELECT k, greatest(0, x1 - x0 - abs(dx)) * greatest(0, y1 - y0 - abs(dy)) AS inter, (x1 - x0) * (y1 - y0) AS a FROM {X.SQL_PART}, s)
SELECT k AS fid, round(min(inter / (2 * a - inter)), 6) AS iou FROM i GROUP BY k
""")
def iou_worst(spark, sf):
    moves = [(a, b) for a in (-3, 0, 3) for b in (-3, 0, 3) if a or b]
    shift = F.explode(F.array(*[F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy")) for a, b in moves])).alias("m")
    w, h = F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin")
    each = X.boxes(spark, sf, geom=False).select("fid", w.alias("w"), h.alias("h"), shift)
    inter = F.greatest(F.col("w") - F.abs("m.dx"), F.lit(0.0)) * F.greatest(F.col("h") - F.abs("m.dy"), F.lit(0.0))
    return each.groupBy("fid").agg(F.round(F.min(A.iou(inter, F.col("w") * F.col("h"), F.col("w") * F.col("h"))), 6).alias("iou"))


@query(f"SELECT s_nationkey, min(x) - 2000 AS xmin, min(y) - 2000 AS ymin, max(x) + 2000 AS xmax, max(y) + 2000 AS ymax FROM {X.SQL_SUPPLIER} GROUP BY 1")
def envelope(spark, sf):
    return graph.extents(spatial.as_points(X.points(spark, sf, "supplier"), "x", "y"), "s_nationkey", 2000.0)


@query(f"SELECT b AS basin_id, round(sum({_INSIDE}) / sum(len), 6) AS ratio FROM {_SEGMENTS}, {X.SQL_BASIN} WHERE k <> 1 AND len > 0 GROUP BY 1")
def containment_ratio(spark, sf):
    s = X.segments(spark, sf).where("fid <> 1")
    total = s.agg(F.sum(F.col("p_size") * 5.0).alias("total"))
    inside = spatial.lines_in(s, X.basins(spark, sf), X.TILE).groupBy(F.col("r_basin_id").alias("basin_id")).agg(F.sum(F.round("inside", 6)).alias("inside"))
    ids = X.basins(spark, sf).select("basin_id").join(inside, "basin_id", "left").crossJoin(F.broadcast(total))  # one row
    return ids.select("basin_id", F.round(F.try_divide(F.coalesce("inside", F.lit(0.0)), F.col("total")), 6).alias("ratio"))


# aggregates


@query("SELECT CASE l_returnflag WHEN 'R' THEN 'Retour' WHEN 'A' THEN 'Accepté' ELSE 'Autre' END AS label, count(*) AS n FROM lineitem GROUP BY 1")
def label_lookup_default(spark, sf):
    dim = spark.createDataFrame([("R", "Retour"), ("A", "Accepté")], "l_returnflag string, label string")
    counted = table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n"))
    return A.labelled(counted, dim, "l_returnflag", "label", "Autre").groupBy("label").agg(F.sum("n").alias("n"))


_FLAG_SQL = f"SELECT p_type, p_brand, k, {X.SQL_OVERLAP} AS o FROM {X.SQL_PART}, (SELECT 200.0 AS bx0, 200.0 AS by0, 800.0 AS bx1, 800.0 AS by1) WHERE {X.SQL_MEET}"


@query(f"SELECT p_type AS label, CAST(sum(o) AS DOUBLE) AS area, count(*) AS n, CAST(row_number() OVER (ORDER BY sum(o) DESC, p_type) AS INTEGER) AS rank, round(100 * sum(o) / 360000, 6) AS part_pct FROM ({_FLAG_SQL}) GROUP BY p_type")
def area_by_class_share(spark, sf):
    met = spatial.overlay(X.boxes(spark, sf), X.one_basin(spark), X.TILE)
    out = A.class_shares(met, ["r_basin_id"], "p_type", F.lit(360000.0))
    return out.select(F.col("p_type").alias("label"), "area", "n", "rank", F.round("part_pct", 6).alias("part_pct"))


@query(f"SELECT p_type, p_brand, CAST(sum(o) AS DOUBLE) AS area, count(*) AS n FROM ({_FLAG_SQL}) GROUP BY GROUPING SETS ((p_type), (p_type, p_brand))")
def two_level_rollup(spark, sf):
    return A.two_levels(spatial.overlay(X.boxes(spark, sf), X.one_basin(spark), X.TILE), "p_type", "p_brand")


@query("""
WITH r AS (SELECT p_brand, sum(CAST(l_extendedprice AS DECIMAL(28,4))) AS v FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1), t AS (SELECT *, sum(v) OVER () AS w FROM r)
SELECT p_brand, CAST(v AS DOUBLE) AS revenue, round(100 * CAST(v AS DOUBLE) / CAST(w AS DOUBLE), 6) AS part_pct, CAST(row_number() OVER (ORDER BY v DESC, p_brand) AS INTEGER) AS rank FROM t QUALIFY rank <= 12
""")
def topn_share(spark, sf):
    by_part = table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.sum(F.col("l_extendedprice").cast("decimal(28,4)")).alias("v"))
    sums = by_part.join(table(spark, sf, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey")).groupBy("p_brand").agg(F.sum("v").cast("double").alias("revenue"))
    total = by_part.agg(F.sum("v").cast("double").alias("total"))
    ranked = A.top(sums.crossJoin(F.broadcast(total)), [], [F.desc("revenue"), F.col("p_brand")], 12)  # one row
    return ranked.select("p_brand", "revenue", F.round(A.share(F.col("revenue"), F.col("total")), 6).alias("part_pct"), "rank")


@query("""
SELECT l_linestatus, CAST(coalesce(sum(CAST(l_quantity AS DECIMAL(28,4))) FILTER (WHERE l_returnflag = 'R'), 0) AS DOUBLE) AS returned,
  CAST(sum(CAST(l_quantity AS DECIMAL(28,4))) FILTER (WHERE l_returnflag <> 'R') AS DOUBLE) AS kept, count(*) FILTER (WHERE l_discount > 0.05) AS discounted FROM lineitem GROUP BY 1
""")
def conditional_sums(spark, sf):
    back = F.col("l_returnflag") == "R"
    return (
        table(spark, sf, "lineitem")
        .groupBy("l_linestatus")
        .agg(F.coalesce(A.exact_sum(F.when(back, F.col("l_quantity"))), F.lit(0.0)).alias("returned"), A.exact_sum(F.when(~back, F.col("l_quantity"))).alias("kept"), F.count_if(F.col("l_discount") > 0.05).alias("discounted"))
    )


@query("SELECT p_brand, count(l_quantity) AS n, CAST(sum(CAST(l_quantity AS DECIMAL(28,4))) AS DOUBLE) AS total, round(avg(l_quantity), 6) AS mean, median(l_quantity) AS median FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1")
def size_stats_median(spark, sf):
    li = table(spark, sf, "lineitem").select("l_partkey", "l_quantity")
    joined = li.join(table(spark, sf, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    return A.size_stats(joined, ["p_brand"], "l_quantity").withColumn("mean", F.round("mean", 6))


@query("""
WITH q AS (SELECT p_type, quantile_cont(p_retailprice, [0, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 1]) AS q, min(p_retailprice) AS lo, max(p_retailprice) AS hi, median(p_retailprice) AS med FROM part GROUP BY 1)
SELECT p_type, unnest([100, 95, 90, 75, 50, 25, 10, 5, 0]) AS part, round(unnest(q), 6) AS z, round(lo, 6) AS z_min, round(hi - lo, 6) AS relief, round(med, 6) AS z_median FROM q
""")
def hypsometry(spark, sf):
    stats = A.elevation_stats(table(spark, sf, "part"), ["p_type"], "p_retailprice")
    each = stats.select("p_type", F.explode("curve").alias("p"), "z_min", "relief", "z_median")
    r = lambda c: F.round(c, 6)
    return each.select("p_type", "p.part", r("p.z").alias("z"), r("z_min").alias("z_min"), r("relief").alias("relief"), r("z_median").alias("z_median"))


@query("SELECT event_id, user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY CAST(ts AS DATE) DESC, event_id) AS n FROM events) WHERE n = 1")
def latest_per_key(spark, sf):
    e = table(spark, sf, "events").withColumn("day", F.to_date("ts"))
    return A.latest(e, ["user_id", "event_type"], "day", "event_id").select("event_id", "user_id", "event_type", "value")


@query("""
WITH e AS (SELECT CASE WHEN event_type = 'view' THEN NULL ELSE event_type END AS usage, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS v FROM events)
SELECT coalesce(usage, 'non précisé') AS usage, count(*) AS n, CAST(sum(CAST(coalesce(v, 0) AS DECIMAL(28,4))) AS DOUBLE) AS volume FROM e GROUP BY 1
""")
def usage_breakdown(spark, sf):
    usage = F.when(F.col("event_type") != "view", F.col("event_type"))
    volume = F.when(F.col("event_id") % 7 != 0, F.col("value"))
    return table(spark, sf, "events").groupBy(F.coalesce(usage, F.lit("non précisé")).alias("usage")).agg(F.count("*").alias("n"), A.exact_sum(F.coalesce(volume, F.lit(0.0))).alias("volume"))


@query("""
WITH g AS (SELECT 'vertebrates' AS "group", user_id FROM events WHERE event_type IN ('view', 'click') UNION ALL SELECT 'mammals', user_id FROM events WHERE event_type = 'view'
  UNION ALL SELECT 'bats', user_id FROM events WHERE event_type = 'view' AND user_id % 3 = 0 UNION ALL SELECT 'total', user_id FROM events)
SELECT "group", count(*) AS n_obs, count(DISTINCT user_id) AS n_species FROM g GROUP BY 1
""")
def overlap_groups_distinct(spark, sf):
    view, click = F.col("event_type") == "view", F.col("event_type") == "click"
    lineage = F.array_compact(F.array(F.when(view | click, F.lit(44)), F.when(view, F.lit(359)), F.when(view & (F.col("user_id") % 3 == 0), F.lit(734))))
    return A.overlapping_groups(table(spark, sf, "events").withColumn("lineage", lineage), "lineage", "user_id", {"vertebrates": 44, "mammals": 359, "bats": 734})


@query("SELECT lang, count_if(toxic = 1) AS toxic_true, count_if(toxic = 0) AS toxic_false, count_if(toxic IS NULL) AS toxic_unknown, max(quality) AS best FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def ternary_counts(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang").join(table(spark, sf, "labels"), "doc_id", "left")
    return d.groupBy("lang").agg(*A.ternary(F.col("toxic") == 1, "toxic"), F.max("quality").alias("best"))


@query("SELECT r_name, string_agg(n_name, ', ' ORDER BY n_name) AS nations FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY 1")
def ordered_listagg(spark, sf):
    r = table(spark, sf, "region").join(table(spark, sf, "nation"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return r.groupBy("r_name").agg(A.joined_text("n_name", "n_name").alias("nations"))


@query("""
WITH s AS (SELECT c_nationkey, c_mktsegment, sum(CAST(c_acctbal AS DECIMAL(28,4))) AS w FROM customer GROUP BY 1, 2)
SELECT c_nationkey, c_mktsegment, CAST(w AS DOUBLE) AS w FROM s QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY w DESC, c_mktsegment) = 1
""")
def dominant_class(spark, sf):
    sums = table(spark, sf, "customer").groupBy("c_nationkey", "c_mktsegment").agg(A.exact_sum("c_acctbal").alias("w"))
    return A.dominant(sums, ["c_nationkey"], "c_mktsegment", "w")


@query(f"""
WITH a AS (SELECT c_nationkey AS z, count(*) AS h, count(*) FILTER (WHERE x BETWEEN 0 AND 400 AND y BETWEEN 0 AND 400) AS i FROM {X.SQL_CUSTOMER} GROUP BY 1)
SELECT n_nationkey AS zone, round((n_nationkey * 1000 + 500) * coalesce(i, 0) / h, 6) AS estimate FROM nation LEFT JOIN a ON z = n_nationkey
""")
def dasymetric_estimate(spark, sf):
    zones = table(spark, sf, "nation").select(F.col("n_nationkey").alias("zone"), (F.col("n_nationkey") * 1000 + 500).cast("double").alias("people"))
    p = X.placed(X.points(spark, sf, "customer")).withColumn("zone", F.col("c_nationkey"))
    basin = X.basins(spark, sf).where("basin_id = 0")
    met = spatial.pairs(p.select("zone", "geom", *spatial.BOX), basin, X.TILE).where(spatial.point_in("geom", "r_geom") == 1)
    count = lambda df: df.groupBy("zone").agg(F.count("*").alias("housing"))
    out = A.dasymetric(zones, count(met), count(p), "zone", "people")
    return out.select("zone", F.round("estimate", 6).alias("estimate"))


@query("""
SELECT l_partkey, l_orderkey, l_linenumber, n_all, truncated FROM (SELECT *, count(*) OVER (PARTITION BY l_partkey) AS n_all, count(*) OVER (PARTITION BY l_partkey) > 5 AS truncated,
  row_number() OVER (PARTITION BY l_partkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_suppkey, l_quantity) AS n FROM lineitem) WHERE n <= 5
""")
def capped_detail_flag(spark, sf):
    li = table(spark, sf, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_extendedprice", "l_suppkey", "l_quantity")
    order = [F.desc("l_extendedprice"), *[F.col(c) for c in ("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity")]]
    return A.capped(li, ["l_partkey"], order, 5).select("l_partkey", "l_orderkey", "l_linenumber", "n_all", "truncated")


@query("""
WITH s AS (SELECT c_mktsegment AS l, count(*) AS n FROM customer GROUP BY 1), p AS (SELECT l, round(100.0 * n / sum(n) OVER (), 6) AS p FROM s),
g AS (SELECT CASE WHEN p >= 20 THEN l END AS l, sum(p) AS p FROM p GROUP BY 1) SELECT coalesce(l, 'Autres') AS label, round(p, 4) AS part_pct FROM g WHERE l IS NOT NULL OR p > 0.05
""")
def chart_groups(spark, sf):
    c = table(spark, sf, "customer").groupBy(F.col("c_mktsegment").alias("label")).agg(F.count("*").alias("n"))
    total = table(spark, sf, "customer").agg(F.count("*").alias("all"))
    shares = c.crossJoin(F.broadcast(total)).select("label", F.round(A.share(F.col("n"), F.col("all")), 6).alias("part_pct"))  # one row
    return A.chart_groups(shares, "label", "part_pct", least=20.0).withColumn("part_pct", F.round("part_pct", 4))


# reshape

_SUMMARY = {"orders_nb": "Eau", "total": "Eau", "first_name": "Agriculture", "late": "Agriculture", "missing": "Agriculture"}


@query("""
WITH s AS (SELECT o_custkey AS id, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(28,4))) AS DOUBLE) AS t, min(o_orderpriority) AS f, max(o_orderstatus) = 'P' AS l FROM orders GROUP BY 1)
SELECT id, 'Eau' AS theme, 'orders_nb' AS field, CAST(n AS DOUBLE) AS number, NULL AS text FROM s UNION ALL SELECT id, 'Eau', 'total', t, NULL FROM s
UNION ALL SELECT id, 'Agriculture', 'first_name', NULL, f FROM s UNION ALL SELECT id, 'Agriculture', 'late', NULL, CASE WHEN l THEN 'true' ELSE 'false' END FROM s
""")
def indicators_long(spark, sf):
    s = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("id")).agg(
        F.count("*").alias("orders_nb"), A.exact_sum("o_totalprice").alias("total"), F.min("o_orderpriority").alias("first_name"), (F.max("o_orderstatus") == "P").alias("late"), F.first(F.lit(None).cast("double")).alias("missing")
    )
    return reshape.indicators(s, "id", _SUMMARY).select("id", "theme", "field", "number", "text")


@query("""
SELECT user_id, coalesce(count(*) FILTER (WHERE event_type = 'click'), 0) AS clicks, nullif(count(*) FILTER (WHERE event_type = 'purchase'), 0) AS purchases, nullif(count(*) FILTER (WHERE event_type = 'signup'), 0) AS signups FROM events GROUP BY 1
""")
def wide_pivot(spark, sf):
    return reshape.pivoted(table(spark, sf, "events"), ["user_id"], "event_type", F.lit(1).cast("long"), {"click": "clicks", "purchase": "purchases", "signup": "signups"}, zero=["clicks"])


@query(f"""
SELECT k AS id, 'clic' AS origin, x, y FROM {X.SQL_SUPPLIER} UNION ALL SELECT k, 'exutoire', x + 1, y FROM {X.SQL_SUPPLIER} WHERE k % 2 = 0 UNION ALL SELECT k, 'reseau', x, y + 1 FROM {X.SQL_SUPPLIER} WHERE k % 3 = 0
""")
def outlet_trace(spark, sf):
    s = X.points(spark, sf, "supplier").select(F.col("key").alias("id"), "x", "y", F.when(F.col("key") % 2 == 0, F.col("x") + 1).alias("ex"), F.when(F.col("key") % 3 == 0, F.col("x")).alias("rx"), (F.col("y") + 1).alias("ry"))
    return reshape.trace(s, "id", {"clic": ("x", "y"), "exutoire": ("ex", "y"), "reseau": ("rx", "ry")})


# grids

_Z = "k * 37 % 101"
_ZSQL = "p_partkey * 37 % 101"


@query(f"SELECT a.r, a.c, max(b.z) AS zmax FROM {X.sql_cells(_ZSQL)} a JOIN {X.sql_cells(_ZSQL)} b ON b.r BETWEEN a.r - 3 AND a.r + 3 AND b.c BETWEEN a.c - 3 AND a.c + 3 GROUP BY 1, 2")
def window_max(spark, sf):
    return windows.window_max(X.grid(spark, sf, _Z), 3).select("r", "c", "zmax")


_PITS = "CASE WHEN k % 97 = 0 THEN -5 WHEN k % 89 = 0 THEN -50 ELSE 400 + k * 37 % 101 END"
_PITSQL = X.sql_cells(_PITS.replace("k ", "p_partkey "))


@query(f"""
WITH g AS {_PITSQL}, s AS (SELECT max(r) AS h, 49 AS w FROM g), o AS (SELECT dr, dc FROM (SELECT unnest(generate_series(-3, 3)) AS dr), (SELECT unnest(generate_series(-3, 3)) AS dc) WHERE greatest(abs(dr), abs(dc)) = 3),
m AS (SELECT a.r, a.c, a.z, median(b.z) AS ring FROM g a, s, o JOIN g b ON b.r = least(greatest(a.r + dr, 0), h) AND b.c = least(greatest(a.c + dc, 0), w) GROUP BY 1, 2, 3)
SELECT r, c, z FROM m WHERE z < -10 OR z > 5000 OR z < ring - 200
""")
def ring_median_spikes(spark, sf):
    return windows.suspects(X.grid(spark, sf, _PITS), F.col("h"), F.col("w")).where("suspect").select("r", "c", "z")


def _slope_sql() -> str:
    at = {k: v for k, v in zip(("nw", "nn", "ne", "ww", "ee", "sw", "ss", "se"), [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b])}
    back = {"nw": "se", "nn": "ss", "ne": "sw", "ww": "ee", "ee": "ww", "sw": "ne", "ss": "nn", "se": "nw"}
    joins = " ".join(f"LEFT JOIN g {n} ON {n}.r = a.r + {dr} AND {n}.c = a.c + {dc}" for n, (dr, dc) in at.items())
    value = ", ".join(f"coalesce({n}.z, 2 * a.z - {back[n]}.z, a.z) AS {n}" for n in at)
    return f"""WITH g AS {X.sql_cells(_ZSQL)}, v AS (SELECT a.r, a.c, {value} FROM g a {joins}),
d AS (SELECT r, c, (ne + 2 * ee + se - nw - 2 * ww - sw) / 80 AS dx, (sw + 2 * ss + se - nw - 2 * nn - ne) / 80 AS dy FROM v)
SELECT r, c, round(degrees(atan(sqrt(dx * dx + dy * dy))), 6) AS slope_deg FROM d"""


@query(_slope_sql())
def slope_horn(spark, sf):
    return windows.slope(X.grid(spark, sf, _Z), 10.0).select("r", "c", F.round("slope_deg", 6).alias("slope_deg"))


@query(f"SELECT r // 5 AS r, c // 5 AS c, round(avg(CASE WHEN k % 8 <> 0 THEN z END), 6) AS z FROM {X.sql_cells(_ZSQL)} GROUP BY 1, 2")
def block_mean(spark, sf):
    return windows.block_mean(X.grid(spark, sf, _Z), 5, valid=F.col("k") % 8 != 0).withColumn("z", F.round("z", 6))


_TILT = "100 * (k div 50) + 10 * (k % 50) + k * 7 % 5"
_TILTSQL = X.sql_cells("100 * (p_partkey // 50) + 10 * (p_partkey % 50) + p_partkey * 7 % 5")
_TILTRIM = "(r = 0 OR c = 0 OR c = 49 OR r = (SELECT max(r) FROM g))"
_TILTWAYS = f"""g AS {_TILTSQL}, m AS (SELECT * FROM (VALUES (1, -1, 1), (2, -1, 0), (3, -1, -1), (4, 0, -1), (5, 1, -1), (6, 1, 0), (7, 1, 1), (8, 0, 1)) m(code, dr, dc)),
n AS (SELECT a.k, b.k AS down, code, (a.z - b.z) / CASE WHEN code % 2 = 1 THEN sqrt(2.0) ELSE 1.0 END AS d FROM g a, m JOIN g b ON b.r = a.r + dr AND b.c = a.c + dc),
w AS (SELECT k, down, code FROM n WHERE d > 0 QUALIFY row_number() OVER (PARTITION BY k ORDER BY d DESC, code) = 1),
p AS (SELECT k, k AS place FROM g UNION ALL SELECT p.k, w.down FROM p JOIN w ON w.k = p.place),
acc AS (SELECT place, count(*) AS n, count(*) FILTER (WHERE {_TILTRIM}) AS open FROM p JOIN g USING (k) GROUP BY 1)"""


@query(f"""
WITH RECURSIVE g AS {_TILTSQL}, m AS (SELECT * FROM (VALUES (1, -1, 1), (2, -1, 0), (3, -1, -1), (4, 0, -1), (5, 1, -1), (6, 1, 0), (7, 1, 1), (8, 0, 1)) m(code, dr, dc)),
n AS (SELECT a.k, b.k AS down, code, (a.z - b.z) / CASE WHEN code % 2 = 1 THEN sqrt(2.0) * 10 ELSE 10.0 END AS d FROM g a, m JOIN g b ON b.r = a.r + dr AND b.c = a.c + dc),
w AS (SELECT k, down, code FROM n WHERE d > 0 QUALIFY row_number() OVER (PARTITION BY k ORDER BY d DESC, code) = 1),
p AS (SELECT k, k AS place FROM g UNION ALL SELECT p.k, w.down FROM p JOIN w ON w.k = p.place), acc AS (SELECT place, count(*) AS acc FROM p GROUP BY 1)
SELECT g.r, g.c, coalesce(w.code, 0) AS code, acc.acc FROM g LEFT JOIN w ON w.k = g.k JOIN acc ON acc.place = g.k
""")
def d8_accumulate(spark, sf):
    cells = X.grid(spark, sf, _TILT)
    ways = windows.steepest(cells, 10.0)
    flat = ways.select("r", "c", "code", (F.col("r") * 50 + F.col("c")).alias("id"), (F.col("n_r") * 50 + F.col("n_c")).alias("down"))
    return flat.join(graph.accumulate(flat.select("id", "down")), "id").select("r", "c", "code", "acc")


@query(f"""
WITH RECURSIVE g AS (SELECT * FROM {X.sql_cells(_ZSQL)} WHERE z > 50), p AS (SELECT k, k AS place FROM g UNION SELECT p.k, b.k FROM p JOIN g a ON a.k = p.place JOIN g b ON abs(b.r - a.r) <= 1 AND abs(b.c - a.c) <= 1),
l AS (SELECT k, min(place) AS label FROM p GROUP BY 1), s AS (SELECT max(p_partkey // 50) AS h FROM part)
SELECT label, count(*) AS n, greatest(min(r) - 3, 0) AS top, greatest(min(c) - 3, 0) AS "left", least(max(r) + 3, max(h)) AS bottom, least(max(c) + 3, 49) AS "right" FROM l JOIN g USING (k), s GROUP BY 1
""")
def components8(spark, sf):
    cells = X.grid(spark, sf, _Z).where("z > 50")
    edges = windows.neighbours(cells, columns=("k",)).select(F.col("k").alias("a"), F.col("n_k").alias("b"))
    label = graph.components(edges, cells.select(F.col("k").alias("id")))
    rows = cells.join(label, F.col("k") == F.col("id"))
    pad = F.lit(3)
    return rows.groupBy("label").agg(
        F.count("*").alias("n"),
        F.greatest(F.min("r") - pad, F.lit(0)).alias("top"),
        F.greatest(F.min("c") - pad, F.lit(0)).alias("left"),
        F.least(F.max("r") + pad, F.max("h") - 1).alias("bottom"),
        F.least(F.max("c") + pad, F.max("w") - 1).alias("right"),
    )


@query(f"""
WITH g AS (SELECT * FROM {X.sql_cells(_ZSQL)} WHERE z > 30), q AS (SELECT a.r, a.c FROM g a JOIN g b ON b.r = a.r AND b.c = a.c + 1 JOIN g c ON c.r = a.r + 1 AND c.c = a.c JOIN g d ON d.r = a.r + 1 AND d.c = a.c + 1)
SELECT r * 50 + c AS v0, (r + 1) * 50 + c AS v1, r * 50 + c + 1 AS v2 FROM q UNION ALL SELECT r * 50 + c + 1, (r + 1) * 50 + c, (r + 1) * 50 + c + 1 FROM q
""")
def mesh_triangles(spark, sf):
    t = windows.mesh(X.grid(spark, sf, _Z).withColumn("z", F.when(F.col("z") > 30, F.col("z"))))
    return t.select(*[(F.col("triangle")[k]["r"] * 50 + F.col("triangle")[k]["c"]).alias(f"v{k}") for k in range(3)])


@query(f"""
WITH g AS (SELECT r, c FROM {X.sql_cells(_ZSQL)} WHERE z > 95) SELECT DISTINCT r + dr AS r, c + dc AS c FROM g, (SELECT unnest(generate_series(-1, 1)) AS dr), (SELECT unnest(generate_series(-1, 1)) AS dc)
""")
def dilate_mask(spark, sf):
    return windows.dilated(X.grid(spark, sf, _Z).where("z > 95"))


@query("""
SELECT p_partkey AS fid, coalesce((SELECT min(s) FROM (SELECT unnest([1, 2, 3, 4, 5]) AS s) WHERE ceil(p_size * 10 / s::DOUBLE) * ceil((1 + p_partkey % 20) * 20 / s::DOUBLE) <= 6500), 5) AS step FROM part
""")
def adaptive_decimation(spark, sf):
    k = F.col("p_partkey")
    return table(spark, sf, "part").select(k.alias("fid"), windows.decimation(F.col("p_size") * 10, (1 + k % 20) * 20).alias("step"))


# networks

_TREE = "(SELECT c_custkey AS id, (c_custkey - 1) // 2 AS parent, c_custkey % 13 = 0 AS canal, c_custkey % 11 <> 0 AS oriented FROM customer WHERE c_custkey > 0)"
_INFLOW = f"SELECT parent AS node, id FROM {_TREE} WHERE NOT canal UNION SELECT id, id FROM {_TREE} WHERE NOT canal AND NOT oriented"
_HEAD = f"SELECT id, id AS node FROM {_TREE} UNION SELECT id, parent FROM {_TREE} WHERE NOT oriented"


@query(f"""
WITH RECURSIVE i AS ({_INFLOW}), h AS ({_HEAD}), s AS (SELECT h.id, i.id AS up FROM h JOIN i USING (node) WHERE h.id <> i.id),
p AS (SELECT id AS b, id FROM (SELECT unnest([1, 2, 11, 13, 44]) AS id) UNION SELECT p.b, s.up FROM p JOIN s ON s.id = p.id)
SELECT CAST(b AS BIGINT) AS basin_id, CAST(id AS BIGINT) AS id FROM p
""")
def upstream_closure(spark, sf):
    seeds = spark.createDataFrame([(k, k) for k in (1, 2, 11, 13, 44)], "basin_id long, id long")
    return graph.upstream_closure(graph.oriented(X.tree(spark, sf)), seeds)


@query(f"SELECT id FROM {_TREE} t WHERE oriented AND NOT EXISTS (SELECT 1 FROM ({_INFLOW}) i WHERE i.node = t.id AND i.id <> t.id)")
def anti_no_inflow(spark, sf):
    return graph.dead_ends(graph.oriented(X.tree(spark, sf))).select("id")


def _strahler_sql(depth: int = 24) -> str:
    """Orders level by level from the leaves of the tree; an unoriented reach is a source and breaks the chain."""
    steps = [f"t AS (SELECT *, CAST(floor(log2(id + 1)) AS INTEGER) AS lev FROM {_TREE})", f"l{depth} AS (SELECT CAST(NULL AS BIGINT) AS id, CAST(NULL AS BIGINT) AS parent, CAST(NULL AS INTEGER) AS o, false AS oriented WHERE false)"]
    for d in range(depth - 1, -1, -1):
        kids = f"SELECT parent, max(o) AS m, count(*) FILTER (WHERE o = (SELECT max(y.o) FROM l{d + 1} y WHERE y.parent = x.parent AND y.oriented)) AS n FROM l{d + 1} x WHERE oriented GROUP BY 1"
        steps.append(f"l{d} AS (SELECT t.id, t.parent, CAST(CASE WHEN NOT t.oriented OR k.m IS NULL THEN 1 WHEN k.n > 1 THEN k.m + 1 ELSE k.m END AS INTEGER) AS o, t.oriented FROM t LEFT JOIN ({kids}) k ON k.parent = t.id WHERE t.lev = {d})")
    return "WITH " + ", ".join(steps) + " " + " UNION ALL ".join(f"SELECT id, o AS strahler_order FROM l{d}" for d in range(depth))


@query(_strahler_sql())
def strahler(spark, sf):
    return graph.strahler(graph.oriented(X.tree(spark, sf)))


@query("""
WITH RECURSIVE p AS (SELECT id AS root, id, CAST(0 AS DOUBLE) AS d FROM (SELECT unnest([0, 1, 2]) AS id) UNION ALL
  SELECT p.root, c_custkey, p.d + 1 + c_custkey % 3 FROM p JOIN customer ON (c_custkey - 1) // 2 = p.id AND c_custkey > 0 WHERE c_custkey NOT IN (0, 1, 2))
SELECT CAST(root AS BIGINT) AS basin_id, CAST(id AS BIGINT) AS far_id, d AS length FROM p QUALIFY row_number() OVER (PARTITION BY root ORDER BY d DESC, id) = 1
""")
def longest_path(spark, sf):
    k = F.col("c_custkey")
    cells = table(spark, sf, "customer").select(k.alias("id"), F.when(k > 0, F.expr("(c_custkey - 1) div 2")).alias("down"), (1 + k % 3).cast("double").alias("step"))
    outlets = spark.createDataFrame([(b, b) for b in (0, 1, 2)], "basin_id long, id long")
    return graph.longest_path(cells, outlets)


# themes, on basins of the regions

_HIT = f"(SELECT b, p_brand, p_type, k, x0, y0, x1, y1, bx0, by0, bx1, by1, {X.SQL_OVERLAP} AS o FROM {X.SQL_PART} JOIN {X.SQL_BASIN} ON {X.SQL_MEET})"


def _basins(spark, sf):
    return X.basins(spark, sf).withColumn("area", F.lit(160_000.0))


@query(f"""
WITH h AS (SELECT *, CAST(1 + k % 5 AS VARCHAR) || '1' || CAST(k % 3 AS VARCHAR) AS code FROM {_HIT}), c AS (SELECT b, code, sum(o) AS a FROM h GROUP BY 1, 2),
d AS (SELECT b, code, a FROM c QUALIFY row_number() OVER (PARTITION BY b ORDER BY a DESC, code) = 1),
s AS (SELECT b, {', '.join(f"round(coalesce(sum(o) FILTER (WHERE left(code, 1) = '{k}'), 0) / 1600, 6) AS {n}" for k, n in T.LAND_COVER.items())} FROM h GROUP BY 1)
SELECT s.b AS basin_id, {', '.join(T.LAND_COVER.values())}, CASE WHEN d.code LIKE '_11' THEN 'Classe ' || d.code ELSE d.code END AS ocs_dominante, round(d.a / 1600, 6) AS ocs_dom_pct FROM s JOIN d ON d.b = s.b
""")
def theme_land_cover(spark, sf):
    k = F.col("fid")
    code = F.concat((1 + k % 5).cast("string"), F.lit("1"), (k % 3).cast("string"))
    labels = spark.createDataFrame([(f"{a}11", f"Classe {a}11") for a in range(1, 6)], "code_18 string, libelle string")
    out = T.land_cover(X.boxes(spark, sf).withColumn("code_18", code), _basins(spark, sf), labels).summary
    return out.select("basin_id", *[F.round(c, 6).alias(c) for c in T.LAND_COVER.values()], "ocs_dominante", F.round("ocs_dom_pct", 6).alias("ocs_dom_pct"))


@query(f"""
WITH h AS (SELECT *, CASE WHEN k % 4 = 0 THEN 'Prairie ' || p_type WHEN k % 4 = 1 THEN NULL ELSE p_type END AS l, CASE k % 5 WHEN 0 THEN 'TA' WHEN 1 THEN 'PP' WHEN 2 THEN 'CP' ELSE 'NA' END AS cat FROM {_HIT}),
g AS (SELECT *, CASE WHEN l IS NOT NULL THEN lower(l) LIKE '%prairie%' ELSE cat = 'PP' END AS grass FROM h)
SELECT b AS basin_id, sum(o) / 10000 AS rpg_ha, count(*) AS rpg_nb, round(median(o) / 10000, 9) AS rpg_med_ha, round(coalesce(sum(o) FILTER (WHERE grass), 0) / 1600, 6) AS herbe_pct, round(coalesce(sum(o) FILTER (WHERE NOT grass), 0) / 1600, 6) AS rpg_cult_pct,
  round(sum(o) FILTER (WHERE cat = 'TA') / 1600, 6) AS rpg_arable_pct, round(sum(o) FILTER (WHERE cat = 'PP') / 1600, 6) AS rpg_prairie_pct FROM g GROUP BY 1
""")
def theme_parcels(spark, sf):
    k = F.col("fid")
    types = table(spark, sf, "part").select("p_type").distinct()
    crops = types.select(F.concat(F.lit("P "), "p_type").alias("code"), F.concat(F.lit("Prairie "), "p_type").alias("libelle")).unionByName(types.select(F.concat(F.lit("T "), "p_type").alias("code"), F.col("p_type").alias("libelle")))
    code = F.when(k % 4 == 0, F.concat(F.lit("P "), "p_type")).when(k % 4 == 1, F.lit("?")).otherwise(F.concat(F.lit("T "), "p_type"))
    cat = F.get(F.array(*map(F.lit, ["TA", "PP", "CP", "NA", "NA"])), (k % 5).cast("int"))
    out = T.declared_parcels(X.boxes(spark, sf).withColumns({"code_cultu": code, "cat_cult_p": cat}), _basins(spark, sf), crops).summary
    r = lambda c, n=6: F.round(c, n).alias(c)
    return out.select("basin_id", "rpg_ha", "rpg_nb", r("rpg_med_ha", 9), r("herbe_pct"), r("rpg_cult_pct"), r("rpg_arable_pct"), r("rpg_prairie_pct"))


@query(f"""
WITH c AS (SELECT b, k % 3 AS kind, unnest(generate_series(CAST(greatest(x0, bx0) AS BIGINT), CAST(least(x1, bx1) AS BIGINT) - 1)) AS cx, greatest(y0, by0) AS lo, least(y1, by1) AS hi FROM {_HIT}),
u AS (SELECT b, kind, cx, unnest(generate_series(CAST(lo AS BIGINT), CAST(hi AS BIGINT) - 1)) AS cy FROM c), n AS (SELECT b, count(*) AS n FROM {_HIT} GROUP BY 1)
SELECT u.b AS basin_id, round(count(DISTINCT cx * 10000 + cy) FILTER (WHERE kind = 0) / 10000.0, 6) AS zsc_ha, round(count(DISTINCT cx * 10000 + cy) FILTER (WHERE kind = 1) / 10000.0, 6) AS zps_ha,
  round(count(DISTINCT cx * 10000 + cy) / 10000.0, 6) AS zonage_ha, round(count(DISTINCT cx * 10000 + cy) / 1600.0, 6) AS zonage_pct, max(n.n) AS zonage_nb FROM u JOIN n USING (b) GROUP BY 1
""")
def theme_zonings(spark, sf):
    sites = X.boxes(spark, sf).select(F.col("p_name").alias("nom_site"), F.col("fid").cast("string").alias("id_mnhn"), "fid", "geom", *spatial.BOX)
    layers_ = {key: [(sites.where(F.col("fid") % 3 == n), None)] for n, key in enumerate(("zsc", "zps", "pnr"))}
    out = T.zonings(layers_, _basins(spark, sf)).summary
    return out.select("basin_id", *[F.round(c, 6).alias(c) for c in ("zsc_ha", "zps_ha", "zonage_ha", "zonage_pct")], "zonage_nb")


# elevation and report data


@query("""
WITH g AS (SELECT p_partkey AS fid, CAST(p_size AS BIGINT) * 300 AS width, (1 + p_partkey % 20) * 500 AS height FROM part),
s AS (SELECT *, CASE WHEN width * height < 1000000 THEN 5000 ELSE least(5000, CAST(ceil(greatest(width, height) / 2) AS BIGINT)) END AS side FROM g),
r AS (SELECT *, unnest(range(0, height, side)) AS "row" FROM s), c AS (SELECT *, unnest(range(0, width, side)) AS col FROM r)
SELECT fid, col, "row", least(side, width - col) AS w, least(side, height - "row") AS h FROM c
""")
def tile_plan(spark, sf):
    k = F.col("p_partkey")
    g = table(spark, sf, "part").select(k.alias("fid"), (F.col("p_size").cast("long") * 300).alias("width"), ((1 + k % 20) * 500).alias("height"))
    return elevation.tile_plan(g, "fid")


@query("""
WITH e AS (SELECT p_brand, p_partkey, 150 + sum(5 + p_size / 4.0) OVER (PARTITION BY p_brand ORDER BY p_partkey ROWS UNBOUNDED PRECEDING) > 281 AS over FROM part)
SELECT p_brand, p_partkey, max(over) OVER (PARTITION BY p_brand ORDER BY p_partkey ROWS UNBOUNDED PRECEDING) AS deferred FROM e
""")
def section_packing(spark, sf):
    blocks = table(spark, sf, "part").select("p_brand", "p_partkey", (5 + F.col("p_size") / 4.0).alias("height"))
    return report.placed(blocks, "p_brand", "p_partkey", "height", 150.0, 281.0).select("p_brand", "p_partkey", "deferred")


@query(f"""
WITH g AS {X.sql_cells(_ZSQL)}, s AS (SELECT max(r) + 1 AS h, 50 AS w FROM g), f AS (SELECT h, w, greatest(greatest(h, w) / 16.0, 1.0) AS f FROM s),
t AS (SELECT h, w, CASE WHEN f <= 1 THEN h ELSE greatest(2, CAST(floor(h / f) AS BIGINT)) END AS th, CASE WHEN f <= 1 THEN w ELSE greatest(2, CAST(floor(w / f) AS BIGINT)) END AS tw FROM f),
a AS (SELECT *, unnest(range(th)) AS tr FROM t), b AS (SELECT *, unnest(range(tw)) AS tc FROM a)
SELECT tr AS r, tc AS c, z FROM b JOIN g ON g.r = CAST(floor((tr + 0.5) * h / th) AS BIGINT) AND g.c = CAST(floor((tc + 0.5) * w / tw) AS BIGINT)
""")
def relief_decimate(spark, sf):
    return report.decimated(X.grid(spark, sf, _Z), [], F.col("h"), F.col("w"), 16)


@query(f"""
WITH g AS {X.sql_cells(_ZSQL)}, s AS (SELECT max(r) + 1 AS h FROM g), a AS (SELECT h, unnest(range(2 * h)) AS fr FROM s), t AS (SELECT h, fr, unnest(range(100)) AS fc FROM a),
p AS (SELECT *, least(greatest((fr + 0.5) / 2 - 0.5, 0), h - 1) AS pr, least(greatest((fc + 0.5) / 2 - 0.5, 0), 49) AS pc FROM t),
q AS (SELECT *, CAST(floor(pr) AS BIGINT) AS r0, CAST(floor(pc) AS BIGINT) AS c0 FROM p)
SELECT fr AS r, fc AS c, round((a.z * (1 - (pc - c0)) + b.z * (pc - c0)) * (1 - (pr - r0)) + (d.z * (1 - (pc - c0)) + e.z * (pc - c0)) * (pr - r0), 6) AS z
FROM q JOIN g a ON a.r = r0 AND a.c = c0 JOIN g b ON b.r = r0 AND b.c = least(c0 + 1, 49) JOIN g d ON d.r = least(r0 + 1, h - 1) AND d.c = c0 JOIN g e ON e.r = least(r0 + 1, h - 1) AND e.c = least(c0 + 1, 49)
""")
def relief_upsample(spark, sf):
    return report.upsampled(X.grid(spark, sf, _Z), [], F.col("h"), F.col("w"), 2).withColumn("z", F.round("z", 6))


@query(f"""
WITH g AS {X.sql_cells(_ZSQL)}, p AS (SELECT s_suppkey AS line, unnest(range(12)) AS n FROM supplier), q AS (SELECT line, n, (line * 7 % 40 + n) * 10 + 5 AS x, (line % 3 + n // 2) * 10 + 5 AS y FROM p),
m AS (SELECT q.*, g.z FROM q LEFT JOIN (SELECT * FROM g WHERE z > 25) g ON g.c = x // 10 AND g.r = y // 10), i AS (SELECT *, sum(CASE WHEN z IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY line ORDER BY n ROWS UNBOUNDED PRECEDING) AS piece FROM m)
SELECT line, n, CAST(piece AS BIGINT) AS piece, z FROM (SELECT * FROM i WHERE z IS NOT NULL) QUALIFY count(*) OVER (PARTITION BY line, piece) >= 2
""")
def line_on_grid(spark, sf):
    p = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("line"), F.explode(F.sequence(F.lit(0), F.lit(11))).alias("n"))
    p = p.withColumns({"x": (F.col("line") * 7 % 40 + F.col("n")) * 10 + 5, "y": (F.col("line") % 3 + F.expr("n div 2")) * 10 + 5})
    return report.laid_on(p, X.grid(spark, sf, _Z).where("z > 25"), [], "line", "n", 10.0).select("line", F.col("n").cast("long").alias("n"), "piece", "z")


@query("""
WITH l AS (SELECT p_partkey AS fid, [p_partkey % 256, p_partkey * 3 % 256, p_partkey * 7 % 256] AS b, p_size / 100.0 AS a1, (p_partkey % 10) / 10.0 AS a2 FROM part),
m AS (SELECT fid, list_transform(b, lambda x: 200 * a1 + x * (1 - a1)) AS m, a2 FROM l)
SELECT fid, CAST(floor(m[1] * (1 - a2) + 10 * a2) AS INTEGER) AS red, CAST(floor(m[2] * (1 - a2) + 20 * a2) AS INTEGER) AS green, CAST(floor(m[3] * (1 - a2) + 30 * a2) AS INTEGER) AS blue FROM m
""")
def composed_layers(spark, sf):
    k = F.col("p_partkey")
    one = lambda rgb, opacity: F.struct(F.array(*map(F.lit, rgb)).alias("rgb"), F.lit(255.0).alias("alpha"), opacity.alias("opacity"))
    layers_ = F.array(one((200, 200, 200), F.col("p_size") / 100.0), one((10, 20, 30), (k % 10) / 10.0))
    out = report.composed(F.array(k % 256, k * 3 % 256, k * 7 % 256), layers_)
    return table(spark, sf, "part").select(k.alias("fid"), *[F.get(out, F.lit(i)).alias(n) for i, n in enumerate(("red", "green", "blue"))])
