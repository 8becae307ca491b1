"""River-network operators: iterations of equi-joins whose state is a table in the shared folder.

A reach has id, ini and fin (its end nodes), direction, artificial, ord (service order). Rounds write their state, so lineage stays
short and a lost executor repeats one round. Each loop ends by itself; ``most`` only guards against bad data.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rillflow.functions import scalar as S
from rillflow.session import Rounds

# Natures of reaches that carry water but drain no basin.
IMPASSABLE = ("canal", "aqueduc", "retenue-bassin portuaire")


# A closure with a budget counts what it has found every so many rounds.
COUNTED = 4


class NotConverged(RuntimeError):
    """A loop reached its guard."""


def oriented(reaches: DataFrame) -> DataFrame:
    """Reaches with up_node and down_node by flow direction, and artificial by nature."""
    up, down = S.flow_nodes("direction", "ini", "fin")
    return reaches.withColumns({"up_node": up, "down_node": down, "artificial": F.coalesce(F.lower(F.trim("nature")).isin(*IMPASSABLE), F.lit(False))})


def merged(known: DataFrame, new: DataFrame, key: str = "id", order: str = "ord") -> DataFrame:
    """Insert-if-new: of each id the first in order, known rows before new ones; rows without id all stay."""
    both = known.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    rank = F.row_number().over(Window.partitionBy(key).orderBy("_new", order))
    first = both.where(F.col(key).isNotNull()).withColumn("_rank", rank).where("_rank = 1").drop("_rank")
    return first.unionByName(both.where(F.col(key).isNull())).drop("_new")


def inflows(reaches: DataFrame) -> DataFrame:
    """(node, id): natural reaches that arrive at a node; unoriented ones arrive at both ends."""
    natural = reaches.where(~F.col("artificial"))
    ends = F.when(F.col("down_node").isNotNull(), F.array("down_node")).otherwise(F.array("ini", "fin"))
    return natural.select(F.explode(ends).alias("node"), "id").where("node is not null")


def heads(reaches: DataFrame) -> DataFrame:
    """(id, node): nodes from which a reach is followed upstream; both ends if it has no upstream node."""
    ends = F.when(F.col("up_node").isNotNull(), F.array("up_node")).otherwise(F.array("ini", "fin"))
    return reaches.select("id", F.explode(ends).alias("node")).where("node is not null")


def upstream_closure(reaches: DataFrame, seeds: DataFrame, most: int = 100_000, hops: int = 3, budget: int | None = None) -> DataFrame:
    """(basin_id, id) of all reaches upstream of each basin's seed reach (basin_id, id), the seed included.

    Each round takes ``hops`` steps against the flow from what the last one found new, and writes only what it finds; artificial reaches are not
    entered, though a seed may be one. All basins go at once. Of reaches without id one is found at most. With a budget, basins of which more
    reaches than that are found are followed no further: every so many rounds they leave, with what they have.
    """
    rounds = Rounds(reaches.sparkSession, "closure")
    step = heads(reaches).join(inflows(reaches).withColumnRenamed("id", "up_id"), "node")
    step = rounds.keep("step", step.select("id", F.col("up_id")).where(~F.col("id").eqNullSafe(F.col("up_id"))).distinct())
    frontier = rounds.append("found", seeds.select("basin_id", "id").distinct())
    for n in range(most):
        found = rounds.all("found")
        if frontier.isEmpty():
            rounds.close("found")
            return found
        reached, last = [], frontier
        if budget is not None and n % COUNTED == COUNTED - 1:
            last = frontier.join(found.groupBy("basin_id").count().where(F.col("count") > budget), "basin_id", "left_anti").select("basin_id", "id")
        for _ in range(hops):
            last = last.join(step, last.id.eqNullSafe(step.id)).select("basin_id", F.col("up_id").alias("id"))
            reached.append(last)
        new = reduce(DataFrame.unionByName, reached).distinct().alias("n")
        old = found.alias("o")
        frontier = rounds.append("found", new.join(old, (F.col("n.basin_id") == F.col("o.basin_id")) & F.col("n.id").eqNullSafe(F.col("o.id")), "left_anti"))
    raise NotConverged(f"closure after {most} rounds")


def dead_ends(reaches: DataFrame) -> DataFrame:
    """Oriented reaches into whose upstream node no other natural reach flows."""
    into = inflows(reaches)
    other = into.select(F.col("node").alias("_node"), F.col("id").alias("_id"))
    rows = reaches.where("up_node is not null")
    return rows.join(other, (F.col("up_node") == F.col("_node")) & ~F.col("id").eqNullSafe(F.col("_id")), "left_anti")


def strahler(reaches: DataFrame, most: int = 100_000) -> DataFrame:
    """(id, strahler_order): sources 1; at a confluence the highest, one more if two or more reach it; in cycles 1.

    Each round hands the orders found last to the reaches below, and orders those all of whose tributaries are known. Written are the new
    orders and what reaches that still wait have got so far, by order, so a round costs what it touches, not all that is done.
    """
    rounds = Rounds(reaches.sparkSession, "strahler")
    rows = reaches.select("id", "up_node", "down_node")
    trib = rows.select(F.col("id").alias("trib"), F.col("down_node").alias("node")).where("node is not null")
    into = rows.join(trib, rows.up_node == trib.node).where("trib <> id").select("id", "trib")
    into = rounds.keep("into", into.withColumn("need", F.count("*").over(Window.partitionBy("id"))))
    fresh = rounds.append("done", rows.join(into.select("id"), "id", "left_anti").select("id", F.lit(1).alias("strahler_order")))
    waiting = None
    for _ in range(most):
        if fresh.isEmpty():
            done = rounds.all("done")
            rounds.close("done")
            return rows.select("id").join(done, "id", "left").select("id", F.coalesce("strahler_order", F.lit(1)).alias("strahler_order"))
        heard = into.join(fresh.withColumnRenamed("id", "trib"), "trib").select("id", "need", "strahler_order", F.lit(1).cast("long").alias("n"))
        heard = heard if waiting is None else heard.unionByName(waiting)
        heard = heard.groupBy("id", "need", "strahler_order").agg(F.sum("n").alias("n"))
        heard = rounds.keep("heard", heard.withColumn("got", F.sum("n").over(Window.partitionBy("id"))))
        top = heard.where("got = need").groupBy("id").agg(F.max(F.struct("strahler_order", "n")).alias("t"))
        fresh = rounds.append("done", top.select("id", (F.col("t.strahler_order") + (F.col("t.n") > 1).cast("int")).alias("strahler_order")))
        waiting = heard.where("got < need").drop("got")
    raise NotConverged(f"orders after {most} rounds")


def pointer_jump(cells: DataFrame, most: int = 64) -> DataFrame:
    """(id, root, distance) of cells (id, down, step): following down to where it ends, in rounds that double the reach.

    A cell without down, or whose down is no cell, is its own root; cells on a cycle come out under a root that is
    not one (``down`` of it is set), and are dropped.
    """
    rounds = Rounds(cells.sparkSession, "jump")
    known = cells.select(F.col("id").alias("down"))
    rows = cells.join(known, "down", "left_semi").select("id", "down", "step")
    rest = cells.join(rows.select("id"), "id", "left_anti")
    state = rows.select("id", F.col("down").alias("root"), F.col("step").cast("double").alias("distance"), F.lit(False).alias("done"))
    state = rounds.keep("state", state.unionByName(rest.select("id", F.col("id").alias("root"), F.lit(0.0).alias("distance"), F.lit(True).alias("done"))))
    for _ in range(most):
        ahead = state.select(F.col("id").alias("_id"), F.col("root").alias("_root"), F.col("distance").alias("_d"), F.col("done").alias("_done"))
        moved = state.where("not done").join(ahead, state.root == F.col("_id"))
        moved = moved.select("id", F.col("_root").alias("root"), (F.col("distance") + F.col("_d")).alias("distance"), F.col("_done").alias("done"))
        state = rounds.keep("state", state.where("done").unionByName(moved))
        left = state.where("not done").agg(F.count("*")).first()[0]
        if not left:
            break
    rounds.close("state")
    return state.where("done").select("id", "root", "distance")


def longest_path(cells: DataFrame, outlets: DataFrame) -> DataFrame:
    """For each outlet (basin_id, id): length of the longest way to it, and the cell where that begins (ties: the smallest id)."""
    at = outlets.select(F.col("id").alias("_out"), "basin_id")
    ended = cells.join(at.select(F.col("_out").alias("id")).distinct(), "id", "left_anti").unionByName(cells.join(at.select(F.col("_out").alias("id")).distinct(), "id", "left_semi").withColumns({"down": F.lit(None).cast(cells.schema["down"].dataType), "step": F.lit(0.0)}))
    ways = pointer_jump(ended).join(at, F.col("root") == F.col("_out"))
    best = F.max_by(F.struct("id", "distance"), F.struct("distance", (-F.col("id")).alias("tie"))).alias("b")
    return ways.groupBy("basin_id").agg(best).select("basin_id", F.col("b.id").alias("far_id"), F.col("b.distance").alias("length"))


def accumulate(cells: DataFrame, weights: Sequence[str] = (), most: int = 64) -> DataFrame:
    """(id, acc, *weights): how many cells drain through each cell (id, down), itself included, and the sums of columns over them; no cycles.

    Sums over paths of fewer than 2^k steps come from those over half as long ones and the pointers 2^(k-1) ahead.
    """
    rounds = Rounds(cells.sparkSession, "accumulate")
    known = cells.select(F.col("id").alias("down"))
    inside = cells.join(known, "down", "left_semi").select("id", "down")
    names = ["acc", *weights]
    state = rounds.keep("state", cells.select("id", *weights).join(inside, "id", "left").select("id", F.col("down").alias("ahead"), F.lit(1).cast("long").alias("acc"), *weights))
    for _ in range(most):
        gain = state.where("ahead is not null").groupBy("ahead").agg(*[F.sum(n).alias(f"gain_{n}") for n in names]).withColumnRenamed("ahead", "id")
        jump = state.select(F.col("id").alias("ahead"), F.col("ahead").alias("next"))
        moved = state.join(gain, "id", "left").join(jump, "ahead", "left")
        state = rounds.keep("state", moved.select("id", F.col("next").alias("ahead"), *[(F.col(n) + F.coalesce(f"gain_{n}", F.lit(0))).alias(n) for n in names]))
        if state.where("ahead is not null").isEmpty():
            rounds.close("state")
            return state.select("id", *names)
    raise NotConverged("flow with a cycle")


def ways(cells: DataFrame, starts: DataFrame, steps: int, most: int = 64) -> DataFrame:
    """(key, id, nth) of the cells on the way down from each start (key, id), the start as the 0th, after ``steps`` steps at most.

    Rounds double the reach of all pointers, and every way found so far goes that far on at once: a way of n cells takes log n rounds.
    """
    rounds = Rounds(cells.sparkSession, "ways")
    known = cells.select(F.col("id").alias("ahead"))
    jump = rounds.keep("jump", cells.select("id", F.col("down").alias("ahead")).where("ahead is not null and ahead <> id").join(known, "ahead", "left_semi").select("id", "ahead"))
    fresh = rounds.append("found", starts.select("key", "id", F.lit(0).cast("long").alias("nth")).join(cells.select("id"), "id", "left_semi").select("key", "id", "nth"))
    for k in range(most):
        further = rounds.all("found").where(F.col("nth") + 2**k <= steps).join(jump, "id").select("key", F.col("ahead").alias("id"), (F.col("nth") + 2**k).alias("nth"))
        fresh = rounds.append("found", further)
        if 2**k > steps or fresh.isEmpty():
            found = rounds.all("found")
            rounds.close("found")
            return found
        next_ = jump.select(F.col("id").alias("ahead"), F.col("ahead").alias("further"))
        jump = rounds.keep("jump", jump.join(next_, "ahead").select("id", F.col("further").alias("ahead")))
    raise NotConverged(f"ways after {most} rounds")


def minimax(edges: DataFrame, root: int, most: int = 64) -> DataFrame:
    """(id, level): the least level at which a node of the graph (a, b, level) reaches the root, that is, the highest edge of its lowest way.

    Rounds after Boruvka: each part that does not hold the root takes its lowest edge outward, which none of its nodes can avoid, and joins
    the part beyond. A node's level is the highest edge that its parts took. Parts at least halve each round, edges inside a part go,
    and of several between two parts the lowest stays. Nodes that never reach the root have no row.
    """
    rounds = Rounds(edges.sparkSession, "minimax")
    both = edges.select("a", "b", "level").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "level")).where("a <> b")
    left = rounds.keep("edges", both.groupBy("a", "b").agg(F.min("level").alias("level")))
    nodes = rounds.keep("nodes", left.select(F.col("a").alias("id")).distinct().select("id", F.col("id").alias("part"), F.lit(None).cast("double").alias("level")))
    for _ in range(most):
        took = left.where(F.col("a") != root).groupBy("a").agg(F.min(F.struct("level", F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"), "b")).alias("e"))
        took = rounds.keep("took", took.select("a", F.col("e.b").alias("b"), F.col("e.level").alias("level")))
        if took.isEmpty():
            rounds.close("nodes")
            return nodes.where(F.col("part") == root).where(F.col("id") != root).select("id", "level")
        back = took.select(F.col("a").alias("b"), F.col("b").alias("a"))
        mutual = took.join(back, ["a", "b"], "left_semi").where("a < b").select("a")  # of two parts that took one edge the smaller leads
        hung = took.join(mutual, "a", "left_anti").select(F.col("a").alias("id"), F.col("b").alias("down"), F.lit(1).alias("step"))
        ends = hung.unionByName(hung.select(F.col("down").alias("id"), F.lit(None).cast("long").alias("down"), F.lit(1).alias("step")).distinct().join(hung.select("id"), "id", "left_anti"))
        heads = rounds.keep("heads", pointer_jump(ends).select("id", "root"))
        nodes = nodes.join(took.select(F.col("a").alias("part"), F.col("level").alias("own")), "part", "left").join(heads.select(F.col("id").alias("part"), "root"), "part", "left")
        nodes = rounds.keep("nodes", nodes.select("id", F.coalesce("root", "part").alias("part"), F.greatest("level", "own").alias("level")))
        ends = [heads.select(F.col("id").alias(n), F.col("root").alias(f"root_{n}")) for n in "ab"]
        moved = left.join(ends[0], "a", "left").join(ends[1], "b", "left").select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"), "level")
        left = rounds.keep("edges", moved.where("a <> b").groupBy("a", "b").agg(F.min("level").alias("level")))
    raise NotConverged(f"levels after {most} rounds")


def components(edges: DataFrame, nodes: DataFrame, most: int = 200) -> DataFrame:
    """(id, label): the smallest id of each node's component; edges (a, b) in either direction.

    Each round hangs all neighbours of a node, itself included, on the smallest of them: first those larger than the node, then those
    smaller. That never adds an edge, and ends in stars after a number of rounds logarithmic in the longest way (Kiveris et al., 2014).
    """
    rounds = Rounds(edges.sparkSession, "components")
    stars = rounds.keep("stars", edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct())
    seen = None
    for _ in range(most):
        mark = tuple(stars.agg(F.count("*"), F.bit_xor(F.xxhash64("hi", "lo"))).first())
        if mark == seen or not mark[0]:
            rounds.close("stars")
            return nodes.join(stars, nodes.id == stars.hi, "left").select("id", F.coalesce("lo", "id").alias("label"))
        seen = mark
        both = stars.unionByName(stars.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        least = both.groupBy("hi").agg(F.min("lo").alias("m")).select("hi", F.least("hi", "m").alias("m"))
        hung = both.where("lo > hi").join(least, "hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).distinct()
        first = hung.groupBy("hi").agg(F.min("lo").alias("m"))
        pair = F.explode(F.array(F.struct("hi", F.col("m").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo"))))
        stars = rounds.keep("stars", hung.join(first, "hi").select(pair.alias("e")).select("e.hi", "e.lo").where("hi <> lo").distinct())
    raise NotConverged(f"components after {most} rounds")


def extents(reaches: DataFrame, key: str, margin: float) -> DataFrame:
    """Envelope of each group's boxes, widened by a margin."""
    m = F.lit(margin)
    return reaches.groupBy(key).agg((F.min("xmin") - m).alias("xmin"), (F.min("ymin") - m).alias("ymin"), (F.max("xmax") + m).alias("xmax"), (F.max("ymax") + m).alias("ymax"))
