"""Queries on general shapes (triangles, holes, several parts) and themes, with the SQL that states their results.

Shape of part k, by k mod 3, in the box of ``shapes``: the right triangle at its lower left corner; the box with a hole of half its
sides; its left and right quarter. Triangle basins: the lower left halves of the basins of ``shapes``. Closed forms: a right triangle of sides w, h beyond
(X, Y) has the area w h / 2 max(0, 1 - (X - x0) / w - (Y - y0) / h)^2, and a box takes four such corners.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from rillflow.functions import geometry as G
from rillflow.operators import spatial
from rillflow.plans import catalogue
from rillflow.plans import queries as Q
from rillflow.plans import shapes as X
from rillflow.plans import themes as T
from rillflow.plans.queries import query
from rillflow.sources.layers import table


@F.pandas_udf(BinaryType())
def _general(kind: pd.Series, x0: pd.Series, y0: pd.Series, x1: pd.Series, y1: pd.Series) -> pd.Series:
    def made(n: int, a: float, b: float, c: float, d: float) -> bytes:
        w, h = c - a, d - b
        if n == 0:
            return G.to_wkb(G.POLYGON, [np.array([[a, b], [c, b], [a, d], [a, b]])])
        if n == 1:
            return G.to_wkb(G.POLYGON, G.box(a, b, c, d) + G.box(a + w / 4, b + h / 4, c - w / 4, d - h / 4))
        return G.to_wkb(G.MULTIPOLYGON, G.box(a, b, a + w / 4, d) + G.box(c - w / 4, b, c, d))

    return pd.Series([made(*row) for row in zip(kind, x0, y0, x1, y1)])


@F.pandas_udf(BinaryType())
def _line(x0: pd.Series, y0: pd.Series, x1: pd.Series, y1: pd.Series) -> pd.Series:
    return pd.Series([G.to_wkb(G.LINE, [np.array([[a, b], [c, d]])]) for a, b, c, d in zip(x0, y0, x1, y1)])


def shapes(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("fid") % 3
    return X.boxes(spark, sf, geom=False).withColumn("geom", _general(kind, *spatial.BOX))


def triangles(spark: SparkSession, sf: str) -> DataFrame:
    """Triangle basins, with area."""
    b = X.basins(spark, sf)
    return b.withColumn("geom", _general(F.lit(0), *spatial.BOX)).withColumn("area", F.lit(80_000.0))


def _corner(x: str, y: str) -> str:
    return f"(x1 - x0) * (y1 - y0) / 2 * pow(greatest(0, 1 - ({x} - x0) / (x1 - x0) - ({y} - y0) / (y1 - y0)), 2)"


def _box_part(x0: str, y0: str, x1: str, y1: str) -> str:
    return f"greatest(0, least({x1}, bx1) - greatest({x0}, bx0)) * greatest(0, least({y1}, by1) - greatest({y0}, by0))"


_LOW, _HIGH = ("greatest(x0, bx0)", "greatest(y0, by0)"), ("greatest(x0, bx0, bx1)", "greatest(y0, by0, by1)")
_TRIANGLE = f"{_corner(_LOW[0], _LOW[1])} - {_corner(_HIGH[0], _LOW[1])} - {_corner(_LOW[0], _HIGH[1])} + {_corner(_HIGH[0], _HIGH[1])}"
_W, _H = "(x1 - x0) / 4", "(y1 - y0) / 4"
_HOLED = f"{_box_part('x0', 'y0', 'x1', 'y1')} - {_box_part(f'x0 + {_W}', f'y0 + {_H}', f'x1 - {_W}', f'y1 - {_H}')}"
_PARTED = f"{_box_part('x0', 'y0', f'x0 + {_W}', 'y1')} + {_box_part(f'x1 - {_W}', 'y0', 'x1', 'y1')}"
_OVER = f"(SELECT k, b, p_brand, p_type, CASE k % 3 WHEN 0 THEN {_TRIANGLE} WHEN 1 THEN {_HOLED} ELSE {_PARTED} END AS o FROM {X.SQL_PART}, {X.SQL_BASIN})"


@query(f"SELECT b AS basin_id, k AS fid, round(o, 6) AS overlap FROM {_OVER} WHERE o > 1e-9")
def overlay_general(spark, sf):
    """Overlap areas of triangles, holed and parted polygons with basins."""
    met = spatial.overlay(shapes(spark, sf), X.basins(spark, sf), X.TILE).where("overlap > 1e-9")
    return met.select(F.col("r_basin_id").alias("basin_id"), "fid", F.round("overlap", 6).alias("overlap"))


@query(f"SELECT b AS basin_id, k AS fid, round(o, 6) AS clipped FROM {_OVER} WHERE o > 1e-9")
def clip_general(spark, sf):
    """Areas of the clipped shapes themselves."""
    met = spatial.pairs(shapes(spark, sf), X.basins(spark, sf), X.TILE).withColumn("part", spatial.clipped("geom", "r_geom")).where("part is not null")
    return met.select(F.col("r_basin_id").alias("basin_id"), "fid", F.round(spatial.measures("part")["area"], 6).alias("clipped")).where("clipped > 0")


@query(f"""
SELECT b AS basin_id, k AS fid FROM {X.SQL_PART}, {X.SQL_BASIN} WHERE k % 3 = 0 AND greatest(x0, bx0) <= bx1 AND greatest(y0, by0) <= by1
  AND (greatest(x0, bx0) - x0) / (x1 - x0) + (greatest(y0, by0) - y0) / (y1 - y0) <= 1
""")
def semi_triangles(spark, sf):
    """Triangles that meet basins, touching included."""
    met = spatial.features_in(shapes(spark, sf).where("fid % 3 = 0"), X.basins(spark, sf), X.TILE)
    return met.select(F.col("r_basin_id").alias("basin_id"), "fid")


@query(f"SELECT b AS basin_id, k AS fid FROM {X.SQL_CUSTOMER}, {X.SQL_BASIN} WHERE x >= bx0 AND y >= by0 AND (x - bx0) + (y - by0) <= 400")
def points_in_triangles(spark, sf):
    p = X.placed(X.points(spark, sf, "customer"))
    met = spatial.pairs(p, triangles(spark, sf), X.TILE).where(spatial.point_in("geom", "r_geom") == 1)
    return met.select(F.col("r_basin_id").alias("basin_id"), F.col("key").alias("fid"))


# a slanting line from the corner of a box, and the stretch of it in a triangle: three half-planes in its parameter t
_SLANT = f"(SELECT k, x0, y0, 5.0 * p_size AS dx, 3.0 * p_size + k % 7 AS dy FROM {X.SQL_PART})"
_T = f"""(SELECT b, k, dx, dy, greatest(0, (bx0 - x0) / dx, (by0 - y0) / dy) AS t0, least(1, (400 - (x0 - bx0) - (y0 - by0)) / (dx + dy)) AS t1 FROM {_SLANT}, {X.SQL_BASIN})"""


@query(f"SELECT b AS basin_id, k AS fid, round((t1 - t0) * sqrt(dx * dx + dy * dy), 6) AS inside FROM {_T} WHERE t1 - t0 > 1e-9")
def lines_in_triangles(spark, sf):
    b = X.boxes(spark, sf, geom=False)
    b = b.withColumn("xmax", F.col("xmin") + 5.0 * F.col("p_size")).withColumn("ymax", F.col("ymin") + 3.0 * F.col("p_size") + F.col("fid") % 7)
    met = spatial.lines_in(b.withColumn("geom", _line(*spatial.BOX)), triangles(spark, sf), X.TILE)
    return met.select(F.col("r_basin_id").alias("basin_id"), "fid", F.round("inside", 6).alias("inside")).where("inside > 1e-6")


@query(f"""
WITH u AS (SELECT p_brand, k, x0, y0, x1, y1, unnest(generate_series(CAST(x0 * 4 AS BIGINT), CAST(x1 * 4 AS BIGINT) - 1)) AS cx FROM {X.SQL_PART} WHERE k % 3 > 0 AND k % 5 = 0),
v AS (SELECT *, unnest(generate_series(CAST(y0 * 4 AS BIGINT), CAST(y1 * 4 AS BIGINT) - 1)) AS cy FROM u),
i AS (SELECT *, (cx + 0.5) / 4 AS mx, (cy + 0.5) / 4 AS my FROM v)
SELECT p_brand, round(count(DISTINCT cx * 100000 + cy) / 16.0, 6) AS area FROM i WHERE CASE k % 3
  WHEN 1 THEN NOT (mx BETWEEN x0 + {_W} AND x1 - {_W} AND my BETWEEN y0 + {_H} AND y1 - {_H}) ELSE mx < x0 + {_W} OR mx > x1 - {_W} END GROUP BY 1
""")
def union_area_general(spark, sf):
    """Unions of holed and parted polygons by brand."""
    rows = shapes(spark, sf).where("fid % 3 > 0 and fid % 5 = 0")
    return spatial.union_areas(rows, ["p_brand"], X.TILE).select("p_brand", F.round("area", 6).alias("area"))


# themes


def _basins(spark: SparkSession, sf: str) -> DataFrame:
    return X.basins(spark, sf).withColumn("area", F.lit(160_000.0))


def _sites(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as point features in service order."""
    return X.points(spark, sf, "customer").withColumn("ord", F.col("key"))


_SITE = f"(SELECT b, s.* FROM {X.SQL_CUSTOMER} s JOIN {X.SQL_BASIN} ON x BETWEEN bx0 AND bx1 AND y BETWEEN by0 AND by1)"


def _by(k: Column, *values: str | None) -> Column:
    return F.get(F.array(*map(F.lit, values)), (k % len(values)).cast("int"))


@query(f"""
WITH s AS (SELECT b, k, CASE k % 5 WHEN 0 THEN NULL WHEN 1 THEN 0.0 ELSE k % 50 / 10.0 END AS h FROM {_SITE})
SELECT b AS basin_id, count(*) AS roe_nb, count(*) FILTER (WHERE k % 3 = 0) AS roe_exist_nb, count(*) FILTER (WHERE k % 4 = 0) AS roe_grenelle, round(CAST(sum(nullif(h, 0)) AS DOUBLE), 6) AS roe_h_cum_m, CAST(max(nullif(h, 0)) AS DOUBLE) AS roe_h_max_m,
  round(count(*) / (b + 1.5), 6) AS roe_par_km FROM s GROUP BY 1
""")
def theme_obstacles(spark, sf):
    k = F.col("key")
    height = F.when(k % 5 == 0, F.lit(None)).when(k % 5 == 1, F.lit("0.0")).otherwise((k % 50 / 10.0).cast("string"))
    names = ["LbHautChutClObstEcoul", "LbTypeDispFranchPiscicole1", "CdObstEcoul", "NomPrincipalObstEcoul", "NomSecondaireObstEcoul", "LbTypeOuvrage", "CdTypeOuvrage", "LbUsageObstEcoul1", "NomEntiteHydrographique"]
    layer = _sites(spark, sf).withColumns({n: F.lit(None).cast("string") for n in names} | {"HautChutEtObstEcoul": height, "LbEtOuvrage": _by(k, "Existant", "Détruit", None), "GrenObstEcoul": _by(k, "true", "false", None, "0")})
    gauges = _sites(spark, sf).where("false").withColumn("CdSiteHydro", F.lit(""))
    km = _basins(spark, sf).select("basin_id", (F.col("basin_id") + 1.5).alias("km"))
    out = T.obstacles(layer, gauges, _basins(spark, sf), km).summary
    return out.select("basin_id", "roe_nb", "roe_exist_nb", "roe_grenelle", F.round(F.col("roe_h_cum_m").cast("double"), 6).alias("roe_h_cum_m"), "roe_h_max_m", F.round("roe_par_km", 6).alias("roe_par_km"))


@query(f"""
WITH s AS (SELECT b, k, CASE WHEN k % 7 = 0 THEN NULL ELSE k % 60 * 100.0 END AS cap, k % 6 <> 0 AS live FROM {_SITE})
SELECT b AS basin_id, count(*) AS steu_nb, count(*) FILTER (WHERE live) AS steu_service_nb, CAST(sum(cap) FILTER (WHERE live) AS DOUBLE) AS steu_capa_tot_eh, count(*) FILTER (WHERE live AND cap >= 2000) AS steu_sup2000_nb FROM s GROUP BY 1
""")
def theme_treatment_plants(spark, sf):
    k = F.col("key")
    names = ["SomChrgMaxEntree", "CdEuZS", "LbExistAutosurv", "CdOuvrageDepollution", "NomOuvrageDepollution", "LbNatureSystTraitementEauxUsees", "DateMiseServiceOuvrageDepollution", "LbConformiteAutosurveillance", "NomZS", "NomAgglomerationAssainissement", "LbCommuneLocalisation"]
    layer = _sites(spark, sf).withColumns({n: F.lit(None).cast("string") for n in names} | {"CapaciteNom": F.when(k % 7 != 0, (k % 60 * 100.0).cast("string")), "DateMiseHorServiceOuvrageDepollution": F.when(k % 6 == 0, F.lit("2010-01-01"))})
    out = T.treatment_plants(layer, _basins(spark, sf)).summary
    return out.select("basin_id", "steu_nb", "steu_service_nb", F.col("steu_capa_tot_eh").cast("double").alias("steu_capa_tot_eh"), "steu_sup2000_nb")


@query(f"SELECT b AS basin_id, round(sum({Q._INSIDE}) / 1000, 9) AS haies_km, round(sum({Q._INSIDE}) / 16, 6) AS haies_dens, count(*) AS haies_nb FROM {Q._SEGMENTS}, {X.SQL_BASIN} WHERE {Q._INSIDE} > 0 GROUP BY 1")
def theme_hedges(spark, sf):
    layer = X.segments(spark, sf).withColumn("ord", F.col("fid"))
    out = T.hedges(layer, _basins(spark, sf)).summary
    return out.select("basin_id", F.round(F.col("haies_km").cast("double"), 9).alias("haies_km"), F.round(F.col("haies_dens").cast("double"), 6).alias("haies_dens"), "haies_nb")


@query(f"SELECT b AS basin_id, round(sum(o) / 10000, 4) AS onf_ha, round(sum(o) / 1600, 4) AS onf_pct, count(*) AS onf_nb FROM {_OVER} WHERE o > 1e-9 GROUP BY 1")
def theme_public_forests(spark, sf):
    """Forests as general polygons."""
    none = F.lit(None).cast("string")
    layer = shapes(spark, sf).withColumns({"cdom_frt": none, "iidtn_frt": none, "llib_frt": none, "ord": F.col("fid")})
    out = T.public_forests(layer, _basins(spark, sf)).summary
    return out.select("basin_id", *[F.round(F.col(c).cast("double"), 4).alias(c) for c in ("onf_ha", "onf_pct")], "onf_nb")


@query(f"SELECT b AS basin_id, round(sum(o) / 10000, 4) AS bati_ha, round(sum(o) / 1600, 4) AS bati_pct FROM {_OVER} WHERE o > 1e-9 GROUP BY 1")
def theme_built_area(spark, sf):
    out = T.simple_area(shapes(spark, sf), _basins(spark, sf), "bati").summary
    return out.select("basin_id", *[F.round(F.col(c).cast("double"), 4).alias(c) for c in ("bati_ha", "bati_pct")])


@query(f"""SELECT s_suppkey AS k, list_aggregate(list_filter({list(catalogue.KEYS)!r}, lambda x: list_contains(string_split(t, ','), x)), 'string_agg', ',') AS chosen FROM
(SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'znieff1,bati,none' WHEN 1 THEN 'sis,corine,rpg,rpg' ELSE 'gbif' END AS t FROM supplier)""")
def selection_text(spark, sf):
    """Selections read and written by the catalogue's own codec."""
    made = {n: catalogue.as_text(catalogue.from_text(t, known=",".join(catalogue.KEYS))) for n, t in enumerate(("znieff1,bati,none", "sis,corine,rpg,rpg", "gbif"))}
    k = F.col("s_suppkey")
    return table(spark, sf, "supplier").select(k.alias("k"), _by(k, *made.values()).alias("chosen"))
