"""Titles, texts, tiles, orders, colours and vertices against small cases and twins in numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillflow.functions import geometry as G
from rillflow.functions import projection
from rillflow.functions import scalar as S
from rillflow.operators import reshape, spatial, windows
from rillflow.plans import catalogue, report


def test_titles(spark):
    df = spark.createDataFrame([("la loire/la Loire", "z", "a"), ("", "zone", "b"), (None, None, "c"), (None, "", None)], "s string, z string, i string")
    got = [r[0] for r in df.select(report.title(F.col("s"), F.col("z"), F.col("i"))).collect()]
    assert got == ["Bassin versant — La loire", "Bassin versant — Zone", "Bassin versant c", "Bassin versant "]
    sub = spark.range(1).select(report.subtitle(F.lit(1.5), F.lit(None).cast("double"), F.lit(""), F.lit(2.5), F.lit(3.0), F.lit("2024-01-01"))).first()[0]
    assert sub == "1.500 km² (0.0 ha) · exutoire 2 ; 3 (Lambert 93) · 2024-01-01"


def test_texts_fall_back(spark):
    texts = spark.createDataFrame([("k", "fr", "un {n}"), ("k", "en", "one {n}"), ("e", "en", "only"), ("e", "fr", ""), ("x", "fr", None)], "key string, lang string, text string")
    df = spark.createDataFrame([("k", "fr"), ("k", "de"), ("e", "fr"), ("x", "fr"), ("none", "fr"), (None, "fr")], "key string, lang string")
    got = {(r.key, r.lang): r.text for r in report.translated(df, "key", "lang", texts).collect()}
    assert got == {("k", "fr"): "un {n}", ("k", "de"): "one {n}", ("e", "fr"): "only", ("x", "fr"): "x", ("none", "fr"): "none", (None, "fr"): None}
    one = spark.createDataFrame([("a {n} {m}", "1", None), ("a {n}", "2", None), ("plain", "3", "4"), (None, "5", "6")], "t string, n string, m string")
    assert [r[0] for r in one.select(S.filled_text("t", n="n", m="m")).collect()] == ["a {n} {m}", "a 2", "plain", None]
    assert [r[0] for r in spark.createDataFrame([("FR_fr",), ("xx",), (None,), ("",)], "l string").select(report.language(F.col("l"))).collect()] == ["fr", "en", "en", "en"]


def test_tiles_leave_no_gap(spark):
    row = spark.createDataFrame([("a", 3, None, "x", 0.5), ("b", None, None, " ", None)], "id string, n int, m double, t string, p double")
    layout = (("A", (("m", 1, ()), ("n", 0, ("t", "m")), ("p", 1, ()))), ("B", (("t", None, ()), ("absent", None, ()))))
    got = [tuple(r) for r in report.tiles(row, "id", layout).orderBy("theme_ord", "place").collect()]
    assert got == [("a", "A", 0, 1, "n", "n", "3", "t : x"), ("a", "A", 0, 2, "p", "p", "0.5", ""), ("a", "B", 1, 1, "t", "t", "x", "")]


def test_orders(spark):
    df = spark.createDataFrame([(1, "Sec", 5.0), (2, "très sec", None), (3, None, 1.0), (4, "aquatique", 5.0), (5, "zz", float(9))], "ord int, label string, a double")
    drawn = report.draw_order(df.withColumn("geom", F.when(F.col("ord") != 5, F.lit(b"x"))), [], "a", "ord").orderBy("draw").collect()
    assert [r.ord for r in drawn] == [1, 4, 3, 2]
    entries = report.legend(df, [], "label", F.col("a"), [s for s, _ in S.MOISTURE_COLOURS]).orderBy("place").collect()
    assert [(r.label, r.area) for r in entries] == [("très sec", 0.0), ("Sec", 5.0), ("aquatique", 5.0), (None, 1.0), ("zz", 9.0)]
    keys = spark.createDataFrame([("sis",), ("metriques",), ("none",), (None,)], "k string")
    assert [r[0] for r in keys.select(catalogue.ordinal(F.col("k"))).collect()] == [catalogue.KEYS.index("sis") + 1, 1, None, None]


def test_differences(spark):
    a = spark.createDataFrame([("x",), ("x",), ("y",), (None,)], "k string")
    b = spark.createDataFrame([("y",), ("z",)], "k string")
    assert sorted(map(str, map(tuple, reshape.differences(a, b, "k").collect()))) == ["('x', 'known')", "('z', 'declared')", "(None, 'known')"]


def test_vertices_are_those_of_numpy(spark):
    z = np.random.default_rng(3).integers(0, 50, (5, 7)).astype(float)
    z[2, 3] = z[0, 0] = np.nan
    rows = [(int(r), int(c), None if np.isnan(z[r, c]) else float(z[r, c]), g) for g in (1, 2) for r in range(5) for c in range(7)] + [(0, 0, None, 3)]
    out = windows.vertices(spark.createDataFrame(rows, "r int, c int, z double, g int"), ["g"], 10.0, 1.5).where("g = 2").orderBy("r", "c").collect()
    h = (np.nan_to_num(z, nan=np.nanmin(z)) - np.nanmin(z)) * 1.5
    south, east = np.gradient(h, 10.0)
    n = np.stack([-east, np.ones_like(h), -south], axis=-1)
    n /= np.linalg.norm(n, axis=-1, keepdims=True)
    assert np.allclose([[r.nx, r.ny, r.nz] for r in out], n.reshape(-1, 3)) and np.allclose([r.py for r in out], h.ravel())
    assert (out[0].px, out[0].pz, out[0].u, out[-1].v) == (-30.0, -20.0, 0.5 / 7, 4.5 / 5)
    assert windows.vertices(spark.createDataFrame(rows, "r int, c int, z double, g int"), ["g"]).where("g = 3").count() == 0


def test_relief_colours(spark):
    df = spark.createDataFrame([(0.0,), (10.0,), (5.0,), (None,), (99.0,)], "z double")
    got = [list(r[0]) for r in df.select(report.as_bytes(report.relief_colour(F.col("z"), F.lit(0.0), F.lit(10.0)))).collect()]
    assert got[0] == got[3] == [51, 51, 153] and got[1] == got[4] == [255, 255, 255]
    assert got[2] == [254, 254, 152]  # step 128 of 255: 0.002 beyond the middle, so 0.6 - 0.002 / 0.25 * 0.27 of blue
    same = spark.range(1).select(report.in_light(F.array(F.lit(0.3)), F.lit(0.5))).first()[0]
    assert same == pytest.approx([0.3])


def test_short_shapes(spark):
    a = np.linspace(0, 2 * np.pi, 2000, endpoint=False)
    rough = np.stack([(1 + 0.2 * np.sin(97 * a)) * np.cos(a), (1 + 0.2 * np.sin(97 * a)) * np.sin(a)], axis=1)
    assert G.short_wkt([rough]).startswith("Polygon ((") and len(G.short_wkt([rough])) <= G.WKT_MAX
    assert G.short_wkt(G.box(0, 0, 4, 4)[0:1] + G.box(1, 1, 2, 2)) == "Polygon ((0 0, 4 0, 4 4, 0 4, 0 0),(1 1, 1 2, 2 2, 2 1, 1 1))"
    assert G.short_wkt(G.box(0, 0, 1, 1) + G.box(3, 0, 4, 1.5)) == "MultiPolygon (((0 0, 1 0, 1 1, 0 1, 0 0)),((3 0, 4 0, 4 1.5, 3 1.5, 3 0)))"
    assert G.short_wkt([G.box(0, 0, 1, 1)[0][::-1]]).startswith("Polygon ((0 0, 1 0")
    small = G.short_wkt([rough], 400)  # nothing but the hull is left
    assert small == G.wkt([G.simplify(G.hull(rough), G.WKT_HULL_TOLERANCE)])
    assert G.area([G.hull(rough)]) > G.area([rough]) and len(G.hull(np.array([[0, 0], [1, 1], [0, 1], [1, 0], [0.5, 0.5], [0.5, 0.0]]))) == 5
    x, y = projection.to_metres(np.array([3.0, 3.1, 3.1]), np.array([46.5, 46.5, 46.6]))
    df = spark.createDataFrame([(bytearray(G.to_wkb(G.POLYGON, [np.stack([x, y], axis=1)[[0, 1, 2, 0]]])),), (None,)], "g binary")
    assert [r[0] for r in df.select(spatial.short_wkt_of_metres("g")).collect()] == ["Polygon ((3 46.5, 3.1 46.5, 3.1 46.6, 3 46.5))", None]
