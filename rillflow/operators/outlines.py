"""Outlines of masks and thinning of rings, as rows: a ring of any length spreads over tasks.

The free sides of a mask's cells are directed edges, the cell on the left hand; each is followed by the edge that begins where it ends, or, where two
cells touch at a corner only, by the one to the right, so that both stay in one ring. Rings and the order in them come from
doubling pointers. Outer rings run counter-clockwise (positive area), holes clockwise. Coordinates are in cells: x the column, y minus the row.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillflow.operators import graph
from rillflow.session import Rounds

#: Sides of a cell (r, c): the neighbour beyond, where the side begins, and its heading (row, column).
_SIDES = (((-1, 0), (0, 1), (0, -1)), ((1, 0), (1, 0), (0, 1)), ((0, -1), (0, 0), (1, 0)), ((0, 1), (1, 1), (-1, 0)))
#: Splits of a round that are broadcast, at most.
FEW = 50_000


def edges(mask: DataFrame, key: str = "key") -> DataFrame:
    """(key, id, r, c, dr, dc): the free sides of the cells (key, r, c) of each mask, from the corner (r, c) on; ids tell edges of one mask apart."""
    cells = mask.select(key, F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c")).distinct()
    side = lambda k: F.struct(*[F.lit(v).cast("long").alias(n) for n, v in zip(("nr", "nc", "br", "bc", "dr", "dc"), sum(_SIDES[k], ()))])
    sides = cells.withColumn("s", F.explode(F.array(*map(side, range(4))))).withColumns({"nr": F.col("r") + F.col("s.nr"), "nc": F.col("c") + F.col("s.nc")})
    free = sides.join(cells.select(key, F.col("r").alias("nr"), F.col("c").alias("nc")), [key, "nr", "nc"], "left_anti")
    begin = free.select(key, (F.col("r") + F.col("s.br")).alias("r"), (F.col("c") + F.col("s.bc")).alias("c"), F.col("s.dr").alias("dr"), F.col("s.dc").alias("dc"))
    return begin.withColumn("id", F.struct(F.col(key).alias("key"), "r", "c", "dr", "dc"))


def rings(mask: DataFrame, key: str = "key", most: int = 64) -> DataFrame:
    """Edges of each mask's outlines with their ring (its smallest edge), its number nth in the ring (that edge the 0th), and turns, whether the heading changes before it."""
    rounds = Rounds(mask.sparkSession, "rings")
    own = rounds.keep("edges", edges(mask, key))
    begin = own.select(key, F.col("r").alias("_r"), F.col("c").alias("_c"), F.col("dr").alias("_dr"), F.col("dc").alias("_dc"), F.col("id").alias("_id"))
    at_end = own.withColumns({"_r": F.col("r") + F.col("dr"), "_c": F.col("c") + F.col("dc")}).join(begin, [key, "_r", "_c"])
    right = (F.col("_dr") == F.col("dc")) & (F.col("_dc") == -F.col("dr"))
    after = at_end.groupBy("id").agg(F.min_by(F.struct("_id", "_dr", "_dc"), F.when(right, 0).otherwise(1)).alias("n"), F.first("dr").alias("dr"), F.first("dc").alias("dc"))
    after = rounds.keep("after", after.select("id", F.col("n._id").alias("next"), ((F.col("n._dr") != F.col("dr")) | (F.col("n._dc") != F.col("dc"))).alias("turns_next")))
    state = rounds.keep("state", after.select("id", F.col("next").alias("ahead"), F.least("id", "next").alias("low"), F.lit(True).alias("moved")))
    for _ in range(most):
        there = state.select(F.col("id").alias("ahead"), F.col("ahead").alias("further"), F.col("low").alias("their"))
        state = rounds.keep("state", state.join(there, "ahead").select("id", F.col("further").alias("ahead"), F.least("low", "their").alias("low"), (F.col("their") < F.col("low")).alias("moved")))
        if state.where("moved").isEmpty():
            break
    else:
        raise graph.NotConverged(f"rings after {most} rounds")
    label = state.select("id", F.col("low").alias("ring"))
    cut = after.join(label, "id").select("id", F.when(F.col("next") != F.col("ring"), F.col("next")).alias("down"), F.lit(1).alias("step"))
    left = graph.pointer_jump(cut).select("id", F.col("distance").cast("long").alias("left"))
    turns = after.select(F.col("next").alias("id"), F.col("turns_next").alias("turns"))
    each = own.join(label, "id").join(left, "id").join(turns, "id")
    length = each.groupBy("ring").agg(F.count("*").alias("length"))
    return each.join(length, "ring").select(key, "ring", (F.col("length") - 1 - F.col("left")).alias("nth"), "r", "c", "dr", "dc", "turns")


def measures(found: DataFrame, cell: float = 1.0, key: str = "key") -> DataFrame:
    """(key, ring, corners, area, perimeter, hole) of rings; the area is positive."""
    twice = -(F.col("c") * (F.col("r") + F.col("dr")) - (F.col("c") + F.col("dc")) * F.col("r"))
    sums = found.groupBy(key, "ring").agg(F.sum(F.col("turns").cast("long")).alias("corners"), F.sum(twice).alias("_a"), (F.count("*") * cell).alias("perimeter"))
    return sums.select(key, "ring", "corners", (F.abs("_a") * cell * cell / 2).alias("area"), "perimeter", (F.col("_a") < 0).alias("hole"))


def largest(found: DataFrame, key: str = "key") -> DataFrame:
    """The rings that outline the largest piece of each mask, without its holes; of pieces as large the one with the smallest edge."""
    outer = measures(found, key=key).where("not hole")
    best = outer.groupBy(key).agg(F.min_by("ring", F.struct(-F.col("area"), "ring")).alias("ring"))
    return found.join(best.select("ring"), "ring", "left_semi")


def corners(found: DataFrame, cell: float = 1.0, x0: float = 0.0, y0: float = 0.0, key: str = "key") -> DataFrame:
    """(key, ring, nth, x, y) of the corners of rings, in order, closed: the first comes again at the end."""
    turned = found.where("turns").select(key, "ring", "nth", (x0 + F.col("c") * cell).alias("x"), (y0 - F.col("r") * cell).alias("y"))
    ends = turned.groupBy(key, "ring").agg(F.min_by(F.struct("x", "y"), "nth").alias("p"))
    last = found.groupBy("ring").agg((F.max("nth") + 1).alias("nth"))
    return turned.unionByName(ends.join(last, "ring").select(key, "ring", "nth", "p.x", "p.y"))


#: Points of a stretch that one task thins to the end; longer ones are split by rounds first. Points of a block of it.
ALONE, BLOCK = 1_000_000, 256


def _farthest(x: np.ndarray, y: np.ndarray, boxes: tuple[np.ndarray, ...], i: int, j: int) -> tuple[int, float]:
    """The point between two points of a line farthest from the way between them, the first of equals, and how far it is.

    Of the blocks that lie wholly between, those whose box (x0, x1, y0, y1) is too near are passed over.
    """
    dx, dy = x[j] - x[i], y[j] - y[i]
    size = math.hypot(dx, dy)

    def away(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.abs(dx * (b - y[i]) - dy * (a - x[i])) / size if size else np.hypot(a - x[i], b - y[i])

    def best(a: int, b: int) -> tuple[float, int]:
        d = away(x[a:b], y[a:b])
        k = int(d.argmax())
        return float(d[k]), -(a + k)

    lo, hi = -(-(i + 1) // BLOCK), j // BLOCK
    if hi - lo < 2:
        d, k = best(i + 1, j)
        return -k, d
    top = max(best(a, b) for a, b in ((i + 1, lo * BLOCK), (hi * BLOCK, j)) if a < b) if i + 1 < lo * BLOCK or hi * BLOCK < j else (-1.0, 0)
    x0, x1, y0, y1 = (b[lo:hi] for b in boxes)
    most = np.maximum.reduce([away(a, b) for a in (x0, x1) for b in (y0, y1)])
    span = max(abs(dx), abs(dy)) / size if size else 1.0
    most += 1e-14 * span * (np.maximum(np.abs(x0 - x[i]), np.abs(x1 - x[i])) + np.maximum(np.abs(y0 - y[i]), np.abs(y1 - y[i])))  # rounding
    for k in np.argsort(-most, kind="stable"):
        if most[k] < top[0]:
            break
        top = max(top, best((lo + k) * BLOCK, (lo + k + 1) * BLOCK))
    return -top[1], top[0]


def _kept(x: np.ndarray, y: np.ndarray, tolerance: float) -> np.ndarray:
    """Places of the points of a line that Douglas and Peucker's rule keeps, without its ends."""
    n = len(x) // BLOCK
    cut = [v[: n * BLOCK].reshape(n, BLOCK) for v in (x, y)]
    boxes = tuple(f(1) for v in cut for f in (v.min, v.max)) if n else ()
    keep, stack = np.zeros(len(x), bool), [(0, len(x) - 1)]
    while stack:
        i, j = stack.pop()
        if j - i > 1:
            k, d = _farthest(x, y, boxes, i, j)
            if d > tolerance:
                keep[k] = True
                stack += [(i, k), (k, j)]
    return np.flatnonzero(keep)


def _alone(work: DataFrame, tolerance: Column | float) -> DataFrame:
    """Kept points of stretches (ring, nth, x, y between p and q), each thinned in one task."""
    names = ["ring", "nth", "x", "y"]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("nth")
        one = rows.iloc[0]
        x, y = (np.r_[one[f"p{v}"], rows[v].to_numpy(), one[f"q{v}"]] for v in "xy")
        return rows[names].iloc[_kept(x, y, one["tolerance"]) - 1]

    ends = [F.col(f"{e}.{v}").alias(f"{e}{v}") for e in "pq" for v in "nxy"]
    rows = work.select(*names, *ends, (tolerance if isinstance(tolerance, Column) else F.lit(float(tolerance))).alias("tolerance"))
    return rows.groupBy("ring", "pn", "qn").applyInPandas(run, work.select(*names).schema)


def thinned(points: DataFrame, tolerance: Column | float, most: int = 10_000) -> DataFrame:
    """Points (ring, nth, x, y) that Douglas and Peucker's rule keeps; the first and last of a ring always stay.

    A stretch between kept points of ``ALONE`` points or fewer is thinned to its end in one task. Of longer ones each round finds the farthest points by one aggregation
    with partial sums, splits those beyond the tolerance (of equally far points at the first) and drops the others.
    """
    rounds = Rounds(points.sparkSession, "thinned")
    rows = points.select("ring", "nth", "x", "y")
    end = lambda f: F.struct(f("nth").alias("n"), F.min_by("x", F.col("nth") * (1 if f is F.min else -1)).alias("x"), F.min_by("y", F.col("nth") * (1 if f is F.min else -1)).alias("y"))
    ends = rounds.keep("ends", rows.groupBy("ring").agg(end(F.min).alias("p"), end(F.max).alias("q")))
    rounds.append("kept", ends.select("ring", F.explode(F.array("p", "q")).alias("e")).select("ring", F.col("e.n").alias("nth"), "e.x", "e.y").distinct())
    inside = rows.join(ends, "ring").where((F.col("nth") > F.col("p.n")) & (F.col("nth") < F.col("q.n")))
    work = rounds.keep("work", inside.select("ring", "nth", "x", "y", "p", "q"))
    dx, dy = F.col("q.x") - F.col("p.x"), F.col("q.y") - F.col("p.y")
    size = F.hypot(dx, dy)
    across = F.abs(dx * (F.col("y") - F.col("p.y")) - dy * (F.col("x") - F.col("p.x"))) / size
    away = F.when(size > 0, across).otherwise(F.hypot(F.col("x") - F.col("p.x"), F.col("y") - F.col("p.y")))
    for _ in range(most):
        top = rounds.keep("top", work.groupBy("ring", F.col("p.n").alias("a"), F.col("q.n").alias("b")).agg(F.max_by(F.struct(F.col("nth").alias("n"), "x", "y"), F.struct(away.alias("d"), (-F.col("nth")).alias("t"))).alias("m"), F.max(away).alias("d"), F.count("*").alias("n")))
        split = rounds.keep("split", top.where((F.col("n") > ALONE) & (F.col("d") > tolerance)).select("ring", "a", "b", "m"))
        short = top.where(F.col("n") <= ALONE).select("ring", "a", "b")
        rounds.append("kept", _alone(work.withColumns({"a": F.col("p.n"), "b": F.col("q.n")}).join(short, ["ring", "a", "b"]), tolerance))
        n = split.count()
        if not n:
            out = rounds.all("kept")
            rounds.close("kept")
            return out
        rounds.append("kept", split.select("ring", F.col("m.n").alias("nth"), "m.x", "m.y"))
        split = F.broadcast(split) if n <= FEW else split
        met = work.withColumns({"a": F.col("p.n"), "b": F.col("q.n")}).join(split, ["ring", "a", "b"]).where(F.col("nth") != F.col("m.n"))
        low = F.col("nth") < F.col("m.n")
        work = rounds.keep("work", met.select("ring", "nth", "x", "y", F.when(low, F.col("p")).otherwise(F.col("m")).alias("p"), F.when(low, F.col("m")).otherwise(F.col("q")).alias("q")))
    raise graph.NotConverged(f"thinning after {most} rounds")


def smoothed(points: DataFrame, share: float = 0.25) -> DataFrame:
    """One pass of corner cutting over closed rings (ring, nth, x, y): two points for each stretch, and the first again at the end.

    Points meet the next ones by their numbers in the ring, which the thinned points get anew.
    """
    order = numbered(points)
    ahead = order.select("ring", (F.col("k") - 1).alias("k"), F.col("x").alias("_x"), F.col("y").alias("_y"))
    met = order.join(ahead, ["ring", "k"])
    cut = lambda a, b, s: a + s * (b - a)
    x, y, nx, ny = (F.col(c) for c in ("x", "y", "_x", "_y"))
    two = F.array(F.struct((F.col("k") * 2).alias("nth"), cut(x, nx, share).alias("x"), cut(y, ny, share).alias("y")), F.struct((F.col("k") * 2 + 1).alias("nth"), cut(nx, x, share).alias("x"), cut(ny, y, share).alias("y")))
    made = met.select("ring", F.explode(two).alias("p")).select("ring", "p.*")
    close = made.groupBy("ring").agg((F.max("nth") + 1).alias("nth"), F.min_by("x", "nth").alias("x"), F.min_by("y", "nth").alias("y"))
    return made.unionByName(close)


#: Numbers in a ring that are ranked together.
STRETCH = 10_000


def numbered(points: DataFrame) -> DataFrame:
    """Points with k, their rank in the ring: ranks within stretches of ``STRETCH`` numbers, and the counts of the stretches before."""
    rows = points.select("ring", "nth", "x", "y", F.floor(F.col("nth") / STRETCH).alias("_s"))
    count = rows.groupBy("ring", "_s").agg(F.count("*").alias("_n"))
    before = count.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy("ring").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rank = F.row_number().over(Window.partitionBy("ring", "_s").orderBy("nth"))
    return rows.withColumn("_k", rank).join(before.select("ring", "_s", "_before"), ["ring", "_s"]).select("ring", "nth", "x", "y", (F.col("_before") + F.col("_k") - 1).alias("k"))


def areas(points: DataFrame) -> DataFrame:
    """(ring, n, area, perimeter) of closed rings of points, n counting the last point too."""
    order = numbered(points)
    ahead = order.select("ring", (F.col("k") - 1).alias("k"), F.col("x").alias("_x"), F.col("y").alias("_y"))
    met = order.join(ahead, ["ring", "k"])
    twice = F.col("x") * F.col("_y") - F.col("_x") * F.col("y")
    return met.groupBy("ring").agg((F.count("*") + 1).alias("n"), F.abs(F.sum(twice) / 2).alias("area"), F.sum(F.hypot(F.col("_x") - F.col("x"), F.col("_y") - F.col("y"))).alias("perimeter"))
