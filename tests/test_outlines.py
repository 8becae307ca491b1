import numpy as np
import pytest
from pyspark.sql import functions as F

from rillflow.functions import geometry as G
from rillflow.operators import outlines as O


def turned(points):
    """A closed ring, begun where it is smallest as a list."""
    p = [tuple(map(float, q)) for q in points[:-1]]
    return min(tuple(p[k:] + p[:k]) for k in range(len(p)))


def by_ring(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: r.nth):
        out.setdefault(r.ring, []).append((r.x, r.y))
    return out


@pytest.mark.parametrize("seed,share", [(1, 0.5), (2, 0.8), (3, 0.3)])
def test_rings_equal_the_kernel(spark, seed, share):
    mask = np.random.default_rng(seed).random((14, 17)) < share
    rows = [(k, int(r), int(c)) for k in (1, 2) for r, c in zip(*np.nonzero(mask if k == 1 else ~mask))]
    found = O.rings(spark.createDataFrame(rows, "key long, r long, c long").repartition(5))
    for k in (1, 2):
        want = G.outline(mask if k == 1 else ~mask)
        got = by_ring(O.corners(found.where(F.col("key") == k)))
        assert sorted(map(turned, got.values())) == sorted(turned(r.tolist()) for r in want)
        sums = {r.ring: r for r in O.measures(found.where(F.col("key") == k)).collect()}
        assert sorted((s.area, s.perimeter, s.hole) for s in sums.values()) == sorted((abs(G.ring_area(r)), G.perimeter([r]), G.ring_area(r) < 0) for r in want)
        for ring, points in got.items():
            assert sums[ring].corners == len(points) - 1 and abs(G.ring_area(np.array(points))) == sums[ring].area
    one = O.measures(O.largest(found)).collect()
    assert sorted(r.key for r in one) == [1, 2] and max(abs(G.ring_area(r)) for r in G.outline(mask)) == next(r.area for r in one if r.key == 1)


def test_thinning_and_smoothing_equal_the_kernel(spark):
    rng = np.random.default_rng(4)
    rings = {}
    for k in range(4):
        t = np.sort(rng.random(60)) * 2 * np.pi
        p = np.round(np.stack([np.cos(t), np.sin(t)], 1) * (10 + rng.random((60, 1)) * 8), 3)
        rings[k] = np.r_[p, p[:1]]
    rows = [(k, int(n) * 7, float(x), float(y)) for k, p in rings.items() for n, (x, y) in enumerate(p)]
    points = spark.createDataFrame(rows, "ring long, nth long, x double, y double").repartition(6)
    thin = O.thinned(points, 2.0)
    smooth = by_ring(O.smoothed(thin))
    for k, p in by_ring(thin).items():
        want = G.simplify(rings[k], 2.0)
        assert p == [tuple(q) for q in want.tolist()]
        assert np.allclose(smooth[k], G.smooth(want))
    for r in O.areas(thin).collect():
        want = G.simplify(rings[r.ring], 2.0)
        assert r.n == len(want) and r.area == pytest.approx(abs(G.ring_area(want))) and r.perimeter == pytest.approx(G.perimeter([want]))


def test_a_long_ring_over_many_tasks(spark):
    n = 200_000
    turn = F.col("id") * (2 * np.pi / n)
    points = spark.range(0, n + 1, 1, 16).select(F.lit(1).alias("ring"), F.col("id").alias("nth"), (1000 * F.cos(turn)).alias("x"), (1000 * F.sin(turn)).alias("y"))
    thin = O.thinned(points, 5.0)
    (r,) = O.areas(thin).collect()
    assert 20 < r.n < 100 and abs(r.area / (np.pi * 1e6) - 1) < 0.02


@pytest.mark.parametrize("alone,most", [(10**6, 2), (700, 200)])
def test_a_zigzag_takes_few_rounds_and_equals_the_kernel(spark, monkeypatch, alone, most):
    monkeypatch.setattr(O, "ALONE", alone, raising=False)
    line = np.array([(3.0 * k, k * 29 % 211) for k in range(0, 24_000, 25)], float)
    rows = [(ring, n, *map(float, p)) for ring in (1, 2) for n, p in enumerate(line)]
    thin = O.thinned(spark.createDataFrame(rows, "ring long, nth long, x double, y double").repartition(5), 47.3, most)
    want = [tuple(q) for q in G.simplify(line, 47.3).tolist()]
    assert by_ring(thin.where("ring = 1")) == {1: want} and by_ring(thin.where("ring = 2")) == {2: want}


def test_empty(spark):
    assert O.rings(spark.createDataFrame([], "key long, r long, c long")).collect() == []
