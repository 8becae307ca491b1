"""Neighbourhoods: runs of tiles, and moving windows over gridded cells (grid, r, c, z).

Window frames along rows and columns where a measure is separable, equi-joins on cell keys where it is not. A grid is spread by
its rows; nothing gathers a grid in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Eight neighbours by flow code, anticlockwise from the north-east; rows grow southward.
MOVES = {1: (-1, 1), 2: (-1, 0), 3: (-1, -1), 4: (0, -1), 5: (1, -1), 6: (1, 0), 7: (1, 1), 8: (0, 1)}

# Elevations that cannot be terrain, and the drop below surroundings that cannot.
LOWEST, HIGHEST, DROP, RING = -10.0, 5000.0, 200.0, 3


def runs(tiles: DataFrame, row: str, col: str) -> DataFrame:
    """Runs of adjacent columns per row: (row, first, last, n)."""
    rank = F.row_number().over(Window.partitionBy(row).orderBy(col))
    island = tiles.select(row, col).distinct().withColumn("_island", F.col(col) - rank)
    return island.groupBy(row, "_island").agg(F.min(col).alias("first"), F.max(col).alias("last"), F.count("*").alias("n")).drop("_island")


def window_max(cells: DataFrame, radius: int, keys: Sequence[str] = ()) -> DataFrame:
    """Cells with zmax, the maximum over the square around each; two passes, as edges repeat values already inside."""
    across = Window.partitionBy(*keys, "r").orderBy("c").rangeBetween(-radius, radius)
    down = Window.partitionBy(*keys, "c").orderBy("r").rangeBetween(-radius, radius)
    return cells.withColumn("_m", F.max("z").over(across)).withColumn("zmax", F.max("_m").over(down)).drop("_m")


def ring_median(cells: DataFrame, candidates: DataFrame, n_rows: Column, n_cols: Column, radius: int = RING, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, r, c, ring): median of the cells at exactly ``radius`` (Chebyshev) around each candidate; beyond an edge its cell repeats."""
    offsets = [(dr, dc) for dr in range(-radius, radius + 1) for dc in range(-radius, radius + 1) if max(abs(dr), abs(dc)) == radius]
    ring = F.explode(F.array(*[F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a, b in offsets])).alias("o")
    at = candidates.select(*keys, "r", "c", n_rows.alias("_h"), n_cols.alias("_w"), ring)
    clamp = lambda v, size: F.least(F.greatest(v, F.lit(0)), size - 1)
    at = at.select(*keys, "r", "c", clamp(F.col("r") + F.col("o.dr"), F.col("_h")).alias("_r"), clamp(F.col("c") + F.col("o.dc"), F.col("_w")).alias("_c"))
    held = cells.select(*keys, F.col("r").alias("_r"), F.col("c").alias("_c"), F.col("z").alias("_z"))
    return at.join(held, [*keys, "_r", "_c"]).groupBy(*keys, "r", "c").agg(F.median("_z").alias("ring"))


def suspects(cells: DataFrame, n_rows: Column, n_cols: Column, keys: Sequence[str] = ()) -> DataFrame:
    """Cells with ``suspect``: absurd elevations, and cells far below the median of the ring around them.

    Only cells far below their window's maximum can be far below the ring's median, so the median is taken for those alone.
    """
    high = window_max(cells, RING, keys)
    may = high.where(F.col("z") < F.col("zmax") - DROP)
    ring = ring_median(cells, may, n_rows, n_cols, RING, keys)
    absurd = (F.col("z") < LOWEST) | (F.col("z") > HIGHEST)
    joined = cells.join(ring, [*keys, "r", "c"], "left")
    return joined.withColumn("suspect", absurd | F.coalesce(F.col("z") < F.col("ring") - DROP, F.lit(False)))


def neighbours(cells: DataFrame, keys: Sequence[str] = (), columns: Sequence[str] = ("z",)) -> DataFrame:
    """Each cell joined to its up to eight neighbours: code, and their columns with the prefix n_."""
    moves = F.explode(F.array(*[F.struct(F.lit(k).alias("code"), F.lit(a).alias("dr"), F.lit(b).alias("dc")) for k, (a, b) in MOVES.items()]))
    around = cells.withColumn("_m", moves).select(*cells.columns, F.col("_m.code").alias("code"), (F.col("r") + F.col("_m.dr")).alias("n_r"), (F.col("c") + F.col("_m.dc")).alias("n_c"))
    other = cells.select(*keys, F.col("r").alias("n_r"), F.col("c").alias("n_c"), *[F.col(x).alias(f"n_{x}") for x in columns])
    return around.join(other, [*keys, "n_r", "n_c"])


def slope(cells: DataFrame, cell: float, keys: Sequence[str] = ()) -> DataFrame:
    """Cells with slope_deg by Horn's 3 x 3 gradient.

    A neighbour missing at an edge or a hole is extrapolated from the opposite neighbour (2 z - opposite), or is z itself if both are missing.
    """
    raw, rows = {}, cells.select(*keys, "r", "c", "z")
    lines = {"r": ("c", "ww", "ee"), "c": ("r", "nn", "ss"), "r - c": ("r", "nw", "se"), "r + c": ("r", "ne", "sw")}
    for line, (along, before, after) in lines.items():  # neighbours along rows, columns and both diagonals
        w = Window.partitionBy(*keys, F.expr(line)).orderBy(along)
        rows = rows.withColumn(before, F.when(F.lag(along).over(w) == F.col(along) - 1, F.lag("z").over(w)))
        rows = rows.withColumn(after, F.when(F.lead(along).over(w) == F.col(along) + 1, F.lead("z").over(w)))
        raw |= {before: F.col(before), after: F.col(after)}
    opposite = {"nw": "se", "nn": "ss", "ne": "sw", "ww": "ee", "ee": "ww", "sw": "ne", "ss": "nn", "se": "nw"}
    v = {k: F.coalesce(x, 2 * F.col("z") - raw[opposite[k]], F.col("z")) for k, x in raw.items()}
    dx = (v["ne"] + 2 * v["ee"] + v["se"] - v["nw"] - 2 * v["ww"] - v["sw"]) / (8 * cell)
    dy = (v["sw"] + 2 * v["ss"] + v["se"] - v["nw"] - 2 * v["nn"] - v["ne"]) / (8 * cell)
    return rows.select(*keys, "r", "c", "z", F.degrees(F.atan(F.sqrt(dx * dx + dy * dy))).alias("slope_deg"))


def block_mean(cells: DataFrame, factor: int, keys: Sequence[str] = (), valid: Column | None = None) -> DataFrame:
    """Mean of the valid cells of each block; null if none is valid."""
    ok = F.lit(True) if valid is None else valid
    block = lambda c: F.floor(F.col(c) / factor).alias(c)
    return cells.groupBy(*keys, block("r"), block("c")).agg(F.avg(F.when(ok, F.col("z"))).alias("z"))


def steepest(cells: DataFrame, cell: float, keys: Sequence[str] = ()) -> DataFrame:
    """Cells (r, c) with code and step of the steepest way down, ties to the lower code; code 0 where none leads down."""
    near = neighbours(cells, keys)
    far = F.when(F.col("code") % 2 == 1, F.lit(2.0 ** 0.5) * cell).otherwise(F.lit(float(cell)))
    ways = near.withColumn("drop", (F.col("z") - F.col("n_z")) / far).where("drop > 0").withColumn("step", far)
    best = F.max_by(F.struct("code", "n_r", "n_c", "step"), F.struct("drop", (-F.col("code")).alias("tie"))).alias("w")
    found = ways.groupBy(*keys, "r", "c").agg(best).select(*keys, "r", "c", "w.*")
    out = cells.select(*keys, "r", "c", "z").join(found, [*keys, "r", "c"], "left")
    return out.withColumn("code", F.coalesce("code", F.lit(0)))


def tiles_of(df: DataFrame, size: int) -> DataFrame:
    """Tiles (tx, ty) that boxes cover, each once."""
    lo, hi = (lambda c: F.floor(F.col(c) / size)), (lambda c: F.floor(F.col(c) / size))
    tx = F.explode(F.sequence(lo("xmin"), hi("xmax"))).alias("tx")
    return df.select("*", tx).select(F.col("tx"), F.explode(F.sequence(lo("ymin"), hi("ymax"))).alias("ty")).distinct()


def touching_tiles(x: Column, y: Column, size: int, margin: float = 1.0) -> Column:
    """Up to four tiles that a point is within ``margin`` of."""
    key = lambda dx, dy: F.struct(F.floor((x + dx) / size).cast("long").alias("tx"), F.floor((y + dy) / size).cast("long").alias("ty"))
    return F.array_distinct(F.array(*[key(a, b) for a in (-margin, margin) for b in (-margin, margin)]))


def mesh(cells: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Two triangles for each square of four cells that all have a value: corner cells (r, c) as arrays."""
    corner = cells.where("z is not null and not isnan(z)").select(*keys, "r", "c")
    out = corner
    for dr, dc in ((0, 1), (1, 0), (1, 1)):
        out = out.join(corner.select(*keys, (F.col("r") - dr).alias("r"), (F.col("c") - dc).alias("c")), [*keys, "r", "c"], "left_semi")
    p = lambda a, b: F.struct((F.col("r") + a).alias("r"), (F.col("c") + b).alias("c"))
    two = F.explode(F.array(F.array(p(0, 0), p(1, 0), p(0, 1)), F.array(p(0, 1), p(1, 0), p(1, 1))))
    return out.select(*keys, two.alias("triangle"))


def vertices(cells: DataFrame, keys: Sequence[str] = (), cell: float = 1.0, exaggeration: float = 1.0) -> DataFrame:
    """The mesh vertex of every cell (r, c, z): position (px east, py up, pz south) around the grid's centre, unit normal
    (nx, ny, nz) and texture place (u, v). Cells without a value lie at the lowest elevation; grids without any value go.

    Slopes reach to the nearest cells on either side, at the edges to one. Rows and columns are windows of their own.
    """
    known = F.when(~F.isnan("z"), F.col("z"))
    size = cells.groupBy(*keys).agg(F.min(known).alias("_low"), (F.max("r") + 1).alias("_h"), (F.max("c") + 1).alias("_w")).where("_low is not null")
    grid = cells.join(size, list(keys)) if keys else cells.crossJoin(F.broadcast(size))  # one row
    grid = grid.withColumn("py", (F.coalesce(known, F.col("_low")) - F.col("_low")) * exaggeration)

    def slope(across: str, along: str) -> Column:
        w = Window.partitionBy(*keys, across).orderBy(along)
        ends = [(F.coalesce(f(c).over(w), F.col(c))) for c in ("py", along) for f in (F.lead, F.lag)]
        return F.coalesce(F.try_divide(ends[0] - ends[1], (ends[2] - ends[3]) * cell), F.lit(0.0))

    grid = grid.withColumn("_east", slope("r", "c")).withColumn("_south", slope("c", "r"))
    size_ = F.sqrt(F.col("_east") * F.col("_east") + F.col("_south") * F.col("_south") + 1)
    px, pz = ((F.col(a) - (F.col(n) - 1) / 2) * cell for a, n in (("c", "_w"), ("r", "_h")))
    return grid.select(
        *keys, "r", "c", px.alias("px"), "py", pz.alias("pz"), ((0 - F.col("_east")) / size_).alias("nx"), (1 / size_).alias("ny"), ((0 - F.col("_south")) / size_).alias("nz"),
        ((F.col("c") + 0.5) / F.col("_w")).alias("u"), ((F.col("r") + 0.5) / F.col("_h")).alias("v"),
    )


def dilated(cells: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Marked cells and their eight neighbours."""
    around = F.explode(F.array(*[F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a in (-1, 0, 1) for b in (-1, 0, 1)]))
    return cells.select(*keys, "r", "c", around.alias("o")).select(*keys, (F.col("r") + F.col("o.dr")).alias("r"), (F.col("c") + F.col("o.dc")).alias("c")).distinct()


def decimation(rows: Column, cols: Column, budget: int = 6500, most: int = 5) -> Column:
    """The smallest step whose decimated grid fits the budget, else the largest."""
    fits = lambda s: F.ceil(rows / s) * F.ceil(cols / s) <= budget
    found = F.array_min(F.filter(F.array(*[F.when(fits(s), F.lit(s)) for s in range(1, most + 1)]), lambda x: x.isNotNull()))
    return F.coalesce(found, F.lit(most))
