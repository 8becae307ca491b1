import pytest

from rillflow.operators import graph

COLS = "id string, ini string, fin string, direction string, nature string, ord long"


def reaches(spark, rows):
    return graph.oriented(spark.createDataFrame([(*r, "Sens direct", "Ecoulement", k) if len(r) == 3 else (*r, k) for k, r in enumerate(rows)], COLS))


Y = [("out", "b", "sea"), ("left", "a", "b"), ("right", "c", "b"), ("l1", "s1", "a"), ("l2", "s2", "a"), ("canal", "z", "a", "Sens direct", "Canal"), ("above", "y", "z"), ("lake", "c", "d", "Sans objet", "Ecoulement"), ("feeder", "s3", "d"), (None, "s4", "d")]


def closure(spark, rows, seed):
    seeds = spark.createDataFrame([("b", seed)], "basin_id string, id string")
    return {r.id for r in graph.upstream_closure(reaches(spark, rows), seeds).collect()}


def test_closure(spark):
    assert closure(spark, Y, "out") == {"out", "left", "right", "l1", "l2", "lake", "feeder", None}
    assert closure(spark, Y, "canal") == {"canal", "above"}
    assert closure(spark, Y, "l1") == {"l1"}


def test_closure_ends_on_cycles(spark):
    rows = [("a", "1", "2"), ("b", "2", "3"), ("c", "3", "1"), ("in", "9", "1"), ("out", "3", "x")]
    assert closure(spark, rows, "out") == {"a", "b", "c", "in", "out"}


def test_closure_leaves_basins_over_budget(spark):
    chain = reaches(spark, [(f"r{k}", str(k + 1), str(k)) for k in range(120)])
    seeds = spark.createDataFrame([("long", "r0"), ("short", "r100")], "basin_id string, id string")
    got = graph.upstream_closure(chain, seeds, budget=25).groupBy("basin_id").count().collect()
    size = {r.basin_id: r["count"] for r in got}
    assert size["short"] == 20 and 25 < size["long"] < 60


def test_dead_ends(spark):
    got = {r.id for r in graph.dead_ends(reaches(spark, Y)).collect()}
    assert got == {"l1", "l2", "above", "feeder", None}


def test_strahler(spark):
    got = {r.id: r.strahler_order for r in graph.strahler(reaches(spark, [r for r in Y if r[0]])).collect()}
    assert got == {"l1": 1, "l2": 1, "above": 1, "canal": 1, "left": 2, "lake": 1, "feeder": 1, "right": 1, "out": 2}
    cycle = {r.id: r.strahler_order for r in graph.strahler(reaches(spark, [("a", "1", "2"), ("b", "2", "1"), ("in", "9", "1"), ("out", "2", "x")])).collect()}
    assert cycle == {"a": 1, "b": 1, "in": 1, "out": 1}


def test_merged(spark):
    known = spark.createDataFrame([("a", 2, "k"), ("a", 1, "first"), (None, 3, "n")], "id string, ord long, v string")
    new = spark.createDataFrame([("a", 0, "late"), ("b", 1, "new"), (None, 3, "n")], "id string, ord long, v string")
    assert sorted(((r.id, r.v) for r in graph.merged(known, new).collect()), key=repr) == [("a", "first"), ("b", "new"), (None, "n"), (None, "n")]


def test_pointer_jump_and_accumulate(spark):
    cells = spark.createDataFrame([(0, None, 0.0), (1, 0, 2.0), (2, 1, 3.0), (3, 99, 1.0), (4, 2, 1.0)], "id long, down long, step double")
    assert {tuple(r) for r in graph.pointer_jump(cells).collect()} == {(0, 0, 0.0), (1, 0, 2.0), (2, 0, 5.0), (3, 3, 0.0), (4, 0, 6.0)}
    assert {r.id: r.acc for r in graph.accumulate(cells.drop("step")).collect()} == {0: 4, 1: 3, 2: 2, 3: 1, 4: 1}
    with pytest.raises(graph.NotConverged):
        graph.accumulate(spark.createDataFrame([(1, 2), (2, 1)], "id long, down long"), most=8)
    best = graph.longest_path(cells, spark.createDataFrame([("x", 1)], "basin_id string, id long")).first()
    assert (best.far_id, best.length) == (4, 4.0)


def test_components(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(1, 40) if k % 10] + [(5, 25)], "a long, b long")
    nodes = spark.range(1, 45)
    got = {r.id: r.label for r in graph.components(edges, nodes).collect()}
    assert [got[k] for k in (1, 10, 11, 20, 21, 30, 31, 40, 44)] == [1, 1, 11, 11, 1, 1, 31, 31, 44]
