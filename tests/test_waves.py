from pyspark.sql import functions as F

from rillflow.functions import geometry as G
from rillflow.operators import graph
from rillflow.plans import terrain
from rillflow.plans import waves as W


def chain(spark, n, side=100.0):
    """A river of n reaches of 60 m from east to west, a tributary at every fifth, and a stream apart from it."""
    import numpy as np

    rows = [(k, k, f"n{k + 1}", f"n{k}", 60.0 * (k + 1), 0.0, 60.0 * k, 0.0) for k in range(n)]
    rows += [(1000 + k, 1000 + k, f"t{k}", f"n{k}", 60.0 * k, 90.0, 60.0 * k, 0.0) for k in range(5, n, 5)]
    rows += [(5000, 5000, "z1", "z0", 30.0, 400.0, 0.0, 400.0)]
    made = [(i, o, a, b, x0, y0, x1, y1, min(x0, x1), min(y0, y1), max(x0, x1), max(y0, y1), bytearray(G.to_wkb(G.LINE, [np.array([[x0, y0], [x1, y1]])]))) for i, o, a, b, x0, y0, x1, y1 in rows]
    names = "id long, ord long, ini string, fin string, x_ini double, y_ini double, x_fin double, y_fin double, xmin double, ymin double, xmax double, ymax double, geom binary"
    return spark.createDataFrame(made, names).withColumns({"nature": F.lit("Ecoulement naturel"), "direction": F.lit("Sens direct")})


def test_only_tiles_along_the_network_are_read_and_a_stopped_outlet_goes_on(spark, tmp_path):
    reaches, size = chain(spark, 12), 150.0
    W.store(reaches, f"{tmp_path}/tiles", size)
    read = W.stored(spark, f"{tmp_path}/tiles")
    outlets = spark.createDataFrame([("a", 20.0, 5.0), ("b", 400.0, 5.0), ("none", 300.0, -900.0)], "basin_id string, x double, y double")
    state = W.start(outlets, read, size)
    got = {r.basin_id: r for r in W.extend(state, read, size, budget=8).collect()}
    assert got["a"].refusal and got["a"].n_reaches < 14 and not got["b"].refusal and "none" not in got
    again = {r.basin_id: r for r in W.extend(state, read, size, budget=1000).collect()}
    assert not again["a"].refusal
    seeds = state.seeds.select("basin_id", "id")
    want = {r.basin_id: r["count"] for r in graph.upstream_closure(graph.oriented(reaches), seeds).groupBy("basin_id").count().collect()}
    assert {k: r.n_reaches for k, r in again.items()} == want == {"a": 14, "b": 7}
    assert again["a"].loaded == 14 and again["b"].loaded < 14, "the stream apart lies in no tile that was read, nor does the river below b"


def test_scan_is_pruned_to_the_tiles_of_a_wave(spark, tmp_path):
    W.store(chain(spark, 12), f"{tmp_path}/tiles", 150.0)
    read = W.stored(spark, f"{tmp_path}/tiles")
    wanted = spark.createDataFrame([(3, 1, 0)], "wave int, tx long, ty long").where("wave = 3")
    plan = read(wanted)._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan.lower()
    assert read(wanted).count() > 0


def test_without_a_budget_the_network_is_followed_to_its_end(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(W, "WAVES", 2)
    W.store(chain(spark, 12), f"{tmp_path}/tiles", 150.0)
    read = W.stored(spark, f"{tmp_path}/tiles")
    state = W.start(spark.createDataFrame([("a", 20.0, 5.0)], "basin_id string, x double, y double"), read, 150.0)
    (got,) = W.extend(state, read, 150.0, budget=None).collect()
    assert got.n_reaches == got.loaded == 14 and got.refusal is None


def test_the_query_has_no_budget(spark, sf_dir, monkeypatch):
    asked = []
    monkeypatch.setattr(W, "extend", lambda state, read, size, budget=8: asked.append(budget) or state.seeds.withColumn("refusal", F.lit(None)))
    terrain.upstream_waves(spark, sf_dir)
    assert asked == [None]
