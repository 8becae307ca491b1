"""Queries on what reports and maps show: titles, texts, tiles, orders, colours, mesh vertices, short shapes, and the basin row."""

from __future__ import annotations

from pyspark.sql import functions as F

from rillflow.functions import scalar as S
from rillflow.operators import reshape, spatial, windows
from rillflow.plans import basin, catalogue, report, schema
from rillflow.plans import general as N
from rillflow.plans import queries as Q
from rillflow.plans import shapes as X
from rillflow.plans import themes as T
from rillflow.plans.queries import query
from rillflow.sources.layers import table


@query(f"""
WITH s AS (SELECT k, p_brand, CASE WHEN k % 9 = 0 THEN NULL ELSE p_size * (1 + k % 20) END AS a FROM {X.SQL_PART} WHERE k % 11 <> 0)
SELECT k AS fid, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY coalesce(a, 0) DESC, k) AS draw FROM s
""")
def draw_order(spark, sf):
    b = X.boxes(spark, sf).withColumn("geom", F.when(F.col("fid") % 11 != 0, F.col("geom")))
    area = F.when(F.col("fid") % 9 != 0, F.col("p_size") * (1 + F.col("fid") % 20)).cast("double")
    return report.draw_order(b.withColumn("area", area), ["p_brand"], "area", "fid").select("fid", "p_brand", "draw")


_CLASS = "lower(p_type) || CASE p_partkey % 3 WHEN 0 THEN ' (sols humides des bords)' WHEN 1 THEN ', autres sols des bords de rivière' ELSE '' END"


@query(f"""
WITH s AS (SELECT p_brand, {_CLASS} AS label, sum(p_size) AS area FROM part GROUP BY 1, 2),
r AS (SELECT *, CASE WHEN starts_with(label, 'standard') THEN 0 WHEN starts_with(label, 'promo') THEN 1 WHEN starts_with(label, 'economy') THEN 2 ELSE 3 END AS rank FROM s)
SELECT p_brand, label, CAST(area AS DOUBLE) AS area, row_number() OVER (PARTITION BY p_brand ORDER BY rank, encode(label)) AS place FROM r
""")
def legend_order(spark, sf):
    return report.legend(table(spark, sf, "part").selectExpr("p_brand", f"{_CLASS} AS label", "p_size"), ["p_brand"], "label", F.col("p_size"), ("standard", "promo", "economy")).drop("short")


@query("""
SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'Bassin versant — ' || upper(left(c_mktsegment, 1)) || substr(lower(c_mktsegment), 2) WHEN c_custkey % 3 = 1 THEN 'Bassin versant — Zone ' || c_nationkey ELSE 'Bassin versant ' || c_custkey END AS title,
  concat_ws(' · ', CASE WHEN c_custkey % 5 <> 0 THEN c_custkey || '.000 km² (' || c_custkey * 100 || '.0 ha)' END, CASE WHEN c_custkey % 4 <> 0 THEN 'masse d''eau FR' || c_nationkey END, CASE WHEN c_custkey % 7 <> 0 THEN 'exutoire ' || c_custkey * 53 || ' ; ' || c_custkey * 29 || ' (Lambert 93)' END) AS subtitle FROM customer
""")
def report_titles(spark, sf):
    k = F.col("c_custkey")
    stream = F.when(k % 3 == 0, F.concat(F.lower("c_mktsegment"), F.lit(" / autre nom"))).otherwise("")
    zone = F.when(k % 3 == 1, F.concat(F.lit("zone "), F.col("c_nationkey").cast("string")))
    body = F.when(k % 4 == 0, F.lit("")).otherwise(F.concat(F.lit("FR"), F.col("c_nationkey").cast("string")))
    x, y = F.when(k % 7 != 0, k * 53).cast("double"), F.when(k % 7 != 0, k * 29).cast("double")
    km2 = F.when(k % 5 != 0, k).cast("double")
    none = F.lit(None).cast("string")
    return table(spark, sf, "customer").select("c_custkey", report.title(stream, zone, k).alias("title"), report.subtitle(km2, km2 * 100, body, x, y, none).alias("subtitle"))


@query("""
WITH t AS (SELECT n_nationkey AS k, CASE WHEN n_nationkey % 5 <> 0 THEN 'pays {n}' END AS fr, CASE WHEN n_nationkey % 4 <> 0 THEN 'country {n} {m}' END AS en FROM nation WHERE n_nationkey % 7 <> 0),
c AS (SELECT c_custkey, CAST(c_nationkey AS VARCHAR) AS key, CASE c_custkey % 4 WHEN 0 THEN 'fr' ELSE 'en' END AS lang FROM customer)
SELECT c_custkey, lang, CASE WHEN k IS NULL THEN key WHEN lang = 'fr' AND fr IS NOT NULL THEN replace(fr, '{n}', key) ELSE coalesce(en, key) END AS text FROM c LEFT JOIN t ON k = CAST(key AS BIGINT)
""")
def translated_texts(spark, sf):
    n = table(spark, sf, "nation").where("n_nationkey % 7 <> 0").withColumn("key", F.col("n_nationkey").cast("string"))
    fr = n.select("key", F.lit("fr").alias("lang"), F.when(F.col("n_nationkey") % 5 != 0, F.lit("pays {n}")).otherwise("").alias("text"))
    en = n.where("n_nationkey % 4 <> 0").select("key", F.lit("en").alias("lang"), F.lit("country {n} {m}").alias("text"))
    locale = N._by(F.col("c_custkey"), "fr_FR", "it_IT", None, "EN")
    asked = table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").cast("string").alias("key"), report.language(locale).alias("lang"))
    out = report.translated(asked, "key", "lang", fr.unionByName(en))
    return out.select("c_custkey", "lang", S.filled_text("text", n="key").alias("text"))


@query("SELECT s_suppkey AS k, t.field, t.place, t.value, t.cited FROM supplier, LATERAL (SELECT unnest(list_filter(["
       "CASE WHEN s_suppkey % 3 <> 0 THEN {'field': 'roe_nb', 'place': 1, 'value': CAST(s_suppkey % 1000 AS VARCHAR), 'cited': CASE WHEN s_suppkey % 2 = 0 THEN 'Obstacles ROE par km de cours d''eau : ' || s_suppkey % 90 ELSE '' END} END,"
       "CASE WHEN s_suppkey % 5 <> 0 THEN {'field': 'vigi_km', 'place': CASE WHEN s_suppkey % 3 <> 0 THEN 2 ELSE 1 END, 'value': s_suppkey % 100 || '.0', 'cited': 'Stations Vigicrues — nombre : 3'} END], lambda x: x IS NOT NULL)) AS t)")
def overview_tiles(spark, sf):
    k = F.col("s_suppkey")
    row = table(spark, sf, "supplier").select(
        k.cast("string").alias("id_bv"), F.when(k % 3 != 0, k % 1000).alias("roe_nb"), F.when(k % 2 == 0, k % 90).alias("roe_par_km"), F.when(k % 5 != 0, k % 100).alias("vigi_km"), F.lit(3).alias("vigi_st_nb"), F.lit(" ").alias("me_code_eu")
    )
    return report.tiles(reshape.fitted(row, schema.BASIN), "id_bv").select(F.col("id_bv").cast("long").alias("k"), "field", "place", "value", "cited")


@query("SELECT DISTINCT s_suppkey % 40 AS k, 'known' AS missing_in FROM supplier WHERE s_suppkey % 40 NOT IN (SELECT n_nationkey + 3 FROM nation) "
       "UNION ALL SELECT n_nationkey + 3, 'declared' FROM nation WHERE n_nationkey + 3 NOT IN (SELECT s_suppkey % 40 FROM supplier)")
def declared_differences(spark, sf):
    declared = table(spark, sf, "supplier").select((F.col("s_suppkey") % 40).alias("k"))
    return reshape.differences(declared, table(spark, sf, "nation").select((F.col("n_nationkey") + 3).alias("k")), "k")


@query(f"SELECT s_suppkey AS k, nullif(coalesce(list_position({list(catalogue.KEYS)!r}, CASE s_suppkey % 4 WHEN 0 THEN 'gbif' WHEN 1 THEN 'metriques' WHEN 2 THEN 'none' END), 0), 0) AS place FROM supplier")
def catalogue_order(spark, sf):
    k = F.col("s_suppkey")
    return table(spark, sf, "supplier").select(k.alias("k"), catalogue.ordinal(N._by(k, "gbif", "metriques", "none", None)).alias("place"))


def _sql_colour(channel: int) -> str:
    pairs = zip(report.RELIEF_COLOURS, report.RELIEF_COLOURS[1:])
    whens = " ".join(f"WHEN x <= {b} THEN {low[channel]} + (x - {a}) / ({b} - {a}) * ({high[channel] - low[channel]!r})" for (a, low), (b, high) in pairs)
    return f"CASE {whens} END"


@query(f"""
WITH g AS (SELECT r, c, z FROM {X.sql_cells(Q._ZSQL)}), b AS (SELECT min(z) AS low, max(z) AS high FROM g),
x AS (SELECT r, c, least(floor((z - low) / (high - low) * 256), 255) / 255 AS x, (r + c) % 5 / 4 AS light FROM g, b),
m AS (SELECT r, c, light, {_sql_colour(0)} AS red, {_sql_colour(1)} AS green, {_sql_colour(2)} AS blue FROM x)
SELECT r, c, {', '.join(f"CAST(floor(least(greatest(2 * light * {k} + (1 - 2 * light) * {k} * {k}, 0), 1) * 255 + 0.5) AS INT) AS {k}" for k in ('red', 'green', 'blue'))} FROM m
""")
def relief_colours(spark, sf):
    cells = X.grid(spark, sf, Q._Z).select("r", "c", "z")
    ends = cells.agg(F.min("z").alias("low"), F.max("z").alias("high"))
    lit = report.in_light(report.relief_colour(F.col("z"), F.col("low"), F.col("high")), (F.col("r") + F.col("c")) % 5 / 4)
    out = cells.crossJoin(F.broadcast(ends)).select("r", "c", report.as_bytes(lit).alias("rgb"))  # one row
    return out.select("r", "c", *[F.col("rgb")[k].alias(n) for k, n in enumerate(("red", "green", "blue"))])


@query(f"""
WITH g AS (SELECT r, c, CASE WHEN z > 30 THEN z END AS z FROM {X.sql_cells(Q._ZSQL)}), b AS (SELECT min(z) AS low, max(r) AS h, max(c) AS w FROM g),
p AS (SELECT r, c, h, w, (coalesce(z, low) - low) * 2 AS py FROM g, b),
s AS (SELECT a.*, coalesce((coalesce(e.py, a.py) - coalesce(i.py, a.py)) / nullif((coalesce(e.c, a.c) - coalesce(i.c, a.c)) * 25, 0), 0) AS sx, coalesce((coalesce(d.py, a.py) - coalesce(u.py, a.py)) / nullif((coalesce(d.r, a.r) - coalesce(u.r, a.r)) * 25, 0), 0) AS sy
  FROM p a LEFT JOIN p e ON e.r = a.r AND e.c = a.c + 1 LEFT JOIN p i ON i.r = a.r AND i.c = a.c - 1 LEFT JOIN p d ON d.r = a.r + 1 AND d.c = a.c LEFT JOIN p u ON u.r = a.r - 1 AND u.c = a.c)
SELECT r, c, (c - w / 2) * 25 AS px, CAST(py AS DOUBLE) AS py, (r - h / 2) * 25 AS pz, round((0 - sx) / sqrt(sx * sx + sy * sy + 1), 9) AS nx, round(1 / sqrt(sx * sx + sy * sy + 1), 9) AS ny, round((0 - sy) / sqrt(sx * sx + sy * sy + 1), 9) AS nz, (c + 0.5) / (w + 1) AS u, (r + 0.5) / (h + 1) AS v FROM s
""")
def mesh_vertices(spark, sf):
    cells = X.grid(spark, sf, Q._Z).select("r", "c", F.when(F.col("z") > 30, F.col("z")).alias("z"))
    out = windows.vertices(cells, cell=25.0, exaggeration=2.0)
    return out.select("r", "c", "px", "py", "pz", *[F.round(n, 9).alias(n) for n in ("nx", "ny", "nz")], "u", "v")


def _sql_pair(x: str, y: str) -> str:
    return f"CAST(CAST({x} AS BIGINT) AS VARCHAR) || ' ' || CAST(CAST({y} AS BIGINT) AS VARCHAR)"


@query(f"SELECT k AS fid, 'Polygon ((' || {_sql_pair('x0', 'y0')} || ', ' || {_sql_pair('x1', 'y0')} || ', ' || {_sql_pair('x1', 'y1')} || ', ' || {_sql_pair('x0', 'y1')} || ', ' || {_sql_pair('x0', 'y0')} || '))' AS text FROM {X.SQL_PART}")
def short_shapes(spark, sf):
    return X.boxes(spark, sf).select("fid", spatial.short_wkt("geom").alias("text"))


_HEDGES, _FORESTS, _BUILT = ("haies_km", "haies_dens", "haies_nb"), ("onf_ha", "onf_pct", "onf_nb"), ("bati_ha", "bati_pct")


def _sql_fields(name: str, fields: tuple[str, ...]) -> str:
    one = "SELECT b, '{0}' AS field, round(coalesce(CAST({0} AS DOUBLE), 0), 4) AS number FROM {2} LEFT JOIN ({1}) ON basin_id = b"
    return " UNION ALL ".join(one.format(f, Q.SQL[name], X.SQL_BASIN) for f in fields)


@query("SELECT CAST(b AS VARCHAR) AS id_bv, field, number FROM (" + " UNION ALL ".join([_sql_fields("theme_hedges", _HEDGES), _sql_fields("theme_public_forests", _FORESTS), _sql_fields("theme_built_area", _BUILT)]) + ")")
def basin_row(spark, sf):
    """What is known in the wide row of three themes, as a long table; a theme that finds nothing in a basin has zeros there."""
    b, none = N._basins(spark, sf), F.lit(None).cast("string")
    lines = X.segments(spark, sf).withColumn("ord", F.col("fid"))
    woods = N.shapes(spark, sf).withColumns({"cdom_frt": none, "iidtn_frt": none, "llib_frt": none, "ord": F.col("fid")})
    themes = {"hedges": lambda: T.hedges(lines, b), "forests": lambda: T.public_forests(woods, b), "built": lambda: T.simple_area(N.shapes(spark, sf), b, "bati")}
    row = basin.assembled(b, [], themes, "2024-01-01").row
    long = reshape.indicators(row, "id_bv", {f.name: "" for f in row.schema if f.name != "date_calcul"})
    return long.select("id_bv", "field", F.round("number", 4).alias("number"))
