"""Elevation: which tiles to read, assembly of a grid, repair of cells that cannot be terrain."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillflow.functions import scalar as S
from rillflow.operators import spatial, windows

# Largest side of a tile and from which size on the longest side is halved; bytes in flight; fill radius.
TILE_SIDE, SPLIT_FROM, IN_FLIGHT, FILL_RADIUS = 5000, 1_000_000, 64 << 20, 10


class FlatGrid(ValueError):
    """A grid of one value: the service had nothing to give there."""


def tile_side(width: Column, height: Column) -> Column:
    """Half the longest side for grids that are worth splitting, at most the service's limit."""
    return F.when(width * height < SPLIT_FROM, F.lit(TILE_SIDE)).otherwise(F.least(F.lit(TILE_SIDE), F.ceil(F.greatest(width, height) / 2))).cast("long")


def in_flight(width: Column, height: Column, workers: int = 4) -> Column:
    """Tiles to read at once within the budget of bytes."""
    return F.greatest(F.lit(1), F.least(F.lit(workers), F.floor(F.lit(IN_FLIGHT) / F.nullif(width * height * 4, F.lit(0))))).cast("int")


def tile_plan(extents: DataFrame, key: str) -> DataFrame:
    """Tiles (key, col, row, w, h) of grids (key, width, height), row by row."""
    side = tile_side(F.col("width"), F.col("height"))
    zero = F.lit(0).cast("long")
    rows = extents.withColumn("side", side).withColumn("row", F.explode(F.sequence(zero, F.col("height") - 1, F.col("side"))))
    rows = rows.withColumn("col", F.explode(F.sequence(zero, F.col("width") - 1, F.col("side"))))
    return rows.select(key, "col", "row", F.least("side", F.col("width") - F.col("col")).alias("w"), F.least("side", F.col("height") - F.col("row")).alias("h"))


def finer_steps(resolution: float, ladder: Sequence[float] = S.RESOLUTIONS) -> list[float]:
    """Cell sizes that divide the current one evenly, nearest first."""
    return [s for s in sorted(ladder, reverse=True) if s < resolution and math.isclose(resolution / s, round(resolution / s))]


def repaired(cells: DataFrame, finer: Sequence[tuple[int, DataFrame]], keys: Sequence[str] = ()) -> DataFrame:
    """Cells (keys, r, c, z, h, w: the grid's size) with suspects replaced, and ``source`` of each value.

    First by the mean of sound cells of finer grids (factor, cells), nearest first, judged anew after each; what
    stays suspect is filled from sound cells around, by inverse squared distance. A hole is never left, as it would
    cut the stream that runs there; where nothing sound is near, the grid's median stands in.
    """
    size = [F.col("h"), F.col("w")]
    on = [*keys, "r", "c"]
    plausible = lambda z: (z >= windows.LOWEST) & (z <= windows.HIGHEST)
    now = cells.select(*on, "z", "h", "w", F.lit("measured").alias("source"))
    for factor, fine in finer:
        mean = windows.block_mean(fine, factor, keys, plausible(F.col("z"))).withColumnRenamed("z", "_fine")
        bad = windows.suspects(now, *size, keys)
        take = F.col("suspect") & plausible(F.col("_fine"))
        now = bad.join(mean, on, "left").select(*on, F.when(take, F.col("_fine")).otherwise(F.col("z")).alias("z"), "h", "w", F.when(take, F.lit("finer")).otherwise(F.col("source")).alias("source"))
    judged = windows.suspects(now, *size, keys)
    point = lambda df: df.select(*keys, F.col("c").cast("double").alias("x"), F.col("r").cast("double").alias("y"), "r", "c", "z")
    bad, good = point(judged.where("suspect")), point(judged.where("not suspect"))
    near = spatial.pairs(spatial.as_points(bad, "x", "y"), spatial.as_points(good, "x", "y"), 16.0, float(FILL_RADIUS))
    for k in keys:
        near = near.where(F.col(k).eqNullSafe(F.col(f"r_{k}")))
    d2 = (F.col("x") - F.col("r_x")) ** 2 + (F.col("y") - F.col("r_y")) ** 2
    fill = near.withColumn("d2", d2).where(F.col("d2") <= FILL_RADIUS**2).groupBy(*on).agg((F.sum(F.col("r_z") / F.col("d2")) / F.sum(1 / F.col("d2"))).alias("_fill"))
    middle = judged.where("not suspect").groupBy(*keys).agg(F.median("z").alias("_mid"))
    out = judged.join(fill, on, "left")
    out = out.join(middle, list(keys), "left") if keys else out.crossJoin(F.broadcast(middle))  # one row
    return out.select(*on, F.when(F.col("suspect"), F.coalesce("_fill", "_mid")).otherwise(F.col("z")).alias("z"), F.when(F.col("suspect"), F.lit("filled")).otherwise(F.col("source")).alias("source"))


def stats(cells: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Minimum, maximum, mean and whether the grid is one value."""
    out = cells.groupBy(*keys).agg(F.min("z").alias("z_min"), F.max("z").alias("z_max"), F.avg("z").alias("z_mean"))
    return out.withColumn("flat", F.col("z_min") == F.col("z_max"))


def checked(cells: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The cells, or an error if a grid is one value throughout."""
    if not stats(cells, keys).where("flat").isEmpty():
        raise FlatGrid("the elevation is constant: nothing is served for this extent")
    return cells
