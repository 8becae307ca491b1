import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillflow import session
from rillflow.operators import drainage as D
from rillflow.operators import graph, hydro


def surface(rng, h, w, levels, holes=0.0):
    z = rng.integers(0, levels, (h, w)).astype(float)
    z[rng.random((h, w)) < holes] = np.nan
    return z


def rows_of(spark, z, parts=5):
    r, c = np.nonzero(np.isfinite(z))
    return spark.createDataFrame([(int(a), int(b), float(z[a, b])) for a, b in zip(r, c)], "r long, c long, z double").repartition(parts)


@pytest.mark.parametrize("seed,shape,levels,size,holes", [(1, (23, 31), 6, 7, 0.0), (2, (40, 17), 3, 8, 0.1), (4, (26, 26), 2, 64, 0.0)])
def test_tiles_equal_the_whole_grid(spark, seed, shape, levels, size, holes):
    z = surface(np.random.default_rng(seed), *shape, levels, holes)
    codes, down = hydro.flow(z)
    got = D.drained(rows_of(spark, z), size)
    acc = {(r.r, r.c): r.acc for r in D.accumulated(got).collect()}
    rim = np.zeros(z.shape, bool)
    rim[[0, -1]] = rim[:, [0, -1]] = True
    want = hydro.drained(down, rim)
    found = got.collect()
    assert len(found) == np.isfinite(z).sum()
    for row in found:
        assert row.code == codes[row.r, row.c], row
        at = down[row.r, row.c]
        assert (row.n_r, row.n_c) == ((None, None) if at < 0 else divmod(int(at), z.shape[1]))
        assert acc[row.r, row.c] == want[row.r, row.c]


def brute_filled(z):
    """Levels by relaxation until nothing changes."""
    h, w = z.shape
    out = np.where(np.isfinite(z), np.inf, np.nan)
    while True:
        new = out.copy()
        for r in range(h):
            for c in range(w):
                if not np.isfinite(z[r, c]):
                    continue
                four = [(r - 1, c), (r + 1, c), (r, c - 1), (r, c + 1)]
                if any(not (0 <= y < h and 0 <= x < w) or not np.isfinite(z[y, x]) for y, x in four):
                    new[r, c] = z[r, c]
                    continue
                near = [out[y, x] for y in range(r - 1, r + 2) for x in range(c - 1, c + 2) if (y, x) != (r, c) and np.isfinite(z[y, x])]
                new[r, c] = min(new[r, c], max(z[r, c], min(near)))
        if np.array_equal(new, out, equal_nan=True):
            return out
        out = new


@pytest.mark.parametrize("seed,size", [(1, 6)])
def test_filled_levels(spark, seed, size):
    z = surface(np.random.default_rng(seed), 21, 24, 12, 0.03)
    want = brute_filled(z)
    for row in D.drained(rows_of(spark, z), size).collect():
        assert row.filled == want[row.r, row.c]


def test_minimax_of_random_graphs(spark):
    rng = random.Random(3)
    edges = [(a, b, float(rng.randrange(20))) for a in range(40) for b in rng.sample(range(-1, 40), 2) if a != b] + [(100, 101, 1.0)]
    level = {-1: -math.inf}
    for _ in range(60):
        for a, b, w in edges:
            for x, y in ((a, b), (b, a)):
                if y in level and max(level[y], w) < level.get(x, math.inf):
                    level[x] = max(level[y], w)
    got = {r.id: r.level for r in graph.minimax(spark.createDataFrame(edges, "a long, b long, level double"), -1).collect()}
    assert got == {k: v for k, v in level.items() if k >= 0}


def test_basins_of_nested_outlets(spark):
    z = surface(np.random.default_rng(8), 30, 26, 9)
    _, down = hydro.flow(z)
    ways = D.drained(rows_of(spark, z), 10)
    numbers = D.numbered(D.accumulated(ways))
    places = [(k, k * 37 % 30, k * 11 % 26) for k in range(40)] + [(k, k * 37 % 30, k * 11 % 26) for k in (100, 1)]
    outlets = spark.createDataFrame([(k, (r << 32) + c) for k, r, c in dict.fromkeys(places)], "key long, id long")
    got = {}
    for row in D.basins(numbers, outlets).collect():
        got.setdefault(row.key, set()).add((row.id >> 32, row.id & (2**32 - 1)))
    values = rows_of(spark, z).select(D.place(), "z")
    sums = {r.key: r for r in D.measured(numbers, outlets, values, ["z"]).collect()}
    for k, r, c in places:
        mask = hydro.above(down, r * 26 + c)
        assert got[k] == set(zip(*map(list, map(np.ndarray.tolist, np.nonzero(mask)))))
        assert (sums[k].cells, sums[k].z_sum, sums[k].z_min, sums[k].z_max) == (mask.sum(), z[mask].sum(), z[mask].min(), z[mask].max())


def test_descent_equals_the_kernel(spark):
    z = surface(np.random.default_rng(5), 25, 25, 7)
    grid = hydro.Grid(z, 0.0, 0.0, 10.0, 20)
    rng = random.Random(2)
    starts = [(k, rng.randrange(25), rng.randrange(25), rng.randrange(250) + 0.5, -rng.randrange(250) - 0.5) for k in range(60)] + [(99, 400, 1, 0.0, 0.0)]
    got = {r.key: (r.r, r.c) for r in D.descended(D.drained(rows_of(spark, z), 8), spark.createDataFrame(starts, "key long, r long, c long, x double, y double"), 10.0).collect()}
    assert got == {k: grid.descend(r, c, x, y) for k, r, c, x, y in starts if k != 99}


def test_descent_over_ten_thousand_cells(spark):
    n = 10_000
    ways = spark.range(n).select(F.lit(0).cast("long").alias("r"), F.col("id").alias("c"), F.lit(0).cast("long").alias("n_r"), F.when(F.col("id") + 1 < n, F.col("id") + 1).alias("n_c"))
    ways = ways.withColumn("n_r", F.when(F.col("n_c").isNotNull(), F.col("n_r")))
    starts = spark.createDataFrame([(1, 0, 0, 98_765.0, 0.0), (2, 0, 50, -3.0, 0.0), (3, 0, 0, 1e9, 0.0)], "key long, r long, c long, x double, y double")
    got = {r.key: (r.c, r.nth) for r in D.descended(ways, starts, 10.0).collect()}
    assert got == {1: (9876, 9876), 2: (50, 0), 3: (9999, 9999)}
    cut = {r.key: r.c for r in D.descended(ways, starts, 10.0, steps=100).collect()}
    assert cut == {1: 99, 2: 50, 3: 99}


def test_tables_of_cells_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(session, "SMALL", 0, raising=False)
    kept = session.Rounds(spark, "plain").keep("rows", spark.range(1000))
    ways = D.drained(rows_of(spark, surface(np.random.default_rng(3), 12, 12, 4)), 8)
    for left, right in ((spark.range(9), kept), (spark.range(9).withColumn("r", F.col("id")), ways)):
        key = "id" if right is kept else "r"
        assert "BroadcastHashJoin" not in left.join(right, key)._jdf.queryExecution().executedPlan().toString()


def test_accumulation_joins_no_broadcast_cells(spark, monkeypatch):
    monkeypatch.setattr(session, "SMALL", 0)
    taken, real = [], graph.accumulate
    monkeypatch.setattr(graph, "accumulate", lambda cells, weights: taken.append(cells.join(spark.range(9), "id")._jdf.queryExecution().executedPlan().toString()) or real(cells, weights))
    ways = D.drained(rows_of(spark, surface(np.random.default_rng(3), 12, 12, 4)), 8)
    assert D.accumulated(ways).count() == 144
    assert len(taken) == 1 and "BroadcastHashJoin" not in taken[0]


def test_cells_of_basin_cells_are_not_broadcast(spark, sf_dir, monkeypatch):
    from rillflow.plans import terrain

    plans = []

    def measured(numbers, outlets, values, names):
        plans.extend(x._jdf.queryExecution().executedPlan().toString() for x in (outlets, numbers.join(values, "id")))
        return spark.createDataFrame([], "key long, cells long, z_min double, z_max double, r_min long, r_max long")

    for name in ("drained", "accumulated"):
        monkeypatch.setattr(D, name, lambda cells, *size: cells)
    monkeypatch.setattr(D, "numbered", lambda cells: spark.range(9))
    monkeypatch.setattr(D, "measured", measured)
    terrain.basin_cells(spark, sf_dir)
    assert len(plans) == 2 and not any("BroadcastHashJoin" in p for p in plans)
