"""Drainage of grids of any size: depressions, directions, accumulation, basins and descents, over tiles and rows.

No group is larger than a tile with its border. Tiles are written once as rows with arrays in binary; what they have to tell
each other (levels, ways over flats) are rows of their border cells. Results equal those of ``hydro.flow`` on the whole grid.

Depressions are filled as a watershed of labels (after Barnes 2016): each tile is flooded from its border cells, each basin of which
gets a label; where two labels meet lies an edge of the spill graph, at the level of their pass; the level at which a label
reaches the grid's rim is the highest edge of its lowest way (``graph.minimax``); no cell of it lies lower in the filled surface. Across flats water takes the shortest
way, found in each tile from what its neighbours know, until no border changes.

Basins are ranges: the drainage is a forest, whose cells are numbered so that all that drains through a cell follows it directly (preorder
within a tree). Whether a cell belongs to an outlet is then a test of its number, and sums over the range come from sums over aligned blocks.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator, Sequence
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillflow.operators import graph, hydro, outlines, windows
from rillflow.session import Rounds

#: Cells along a tile's side.
TILE = 256
#: A label's number: 21 bits each for a tile's row and column, 20 for the label in it; the outside is -1.
_OUT = -1
#: Blocks of numbers are powers of this, up to the last power.
_BLOCK, _POWERS = 64, 6


def _label(tr: Column, tc: Column, n: Column) -> Column:
    return F.when(n == 0, F.lit(_OUT)).otherwise((tr * 2**21 + tc) * 2**20 + n).cast("long")


def _floored(z: np.ndarray, rim: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray, dict[tuple[int, int], float]]:
    """(filled, labels, passes) of a tile flooded from its rim (label 0) and its edge cells; labels of cells without value are -1."""
    h, w = z.shape
    filled, label = z.copy(), np.full((h, w), -1, np.int32)
    label[rim] = 0
    seed = rim | edge
    heap = [(float(z[r, c]), int(r) * w + int(c)) for r, c in zip(*np.nonzero(seed))]
    heapq.heapify(heap)
    around, n, passes = [(dr, dc) for dr, dc in windows.MOVES.values()], 0, {}
    while heap:
        level, at = heapq.heappop(heap)
        r, c = divmod(at, w)
        own = label[r, c]
        if own < 0:
            n += 1
            own = label[r, c] = n
        for dr, dc in around:
            y, x = r + dr, c + dc
            if not (0 <= y < h and 0 <= x < w) or z[y, x] != z[y, x]:
                continue
            other = label[y, x]
            if other < 0:
                label[y, x] = own
                if not seed[y, x]:
                    filled[y, x] = max(z[y, x], level)
                    heapq.heappush(heap, (float(filled[y, x]), y * w + x))
            elif other != own:
                pair, at_pass = (min(own, other), max(own, other)), max(level, float(filled[y, x]))
                passes[pair] = min(passes.get(pair, at_pass), at_pass)
    return filled, label, {(int(a), int(b)): v for (a, b), v in passes.items()}


def _border(r: Column, c: Column, size: int, inner: bool) -> Column:
    """The tiles that a cell lies in or borders on; without its own if not ``inner``."""
    tile = lambda dr, dc: F.struct(F.floor((r + dr) / size).cast("long").alias("tr"), F.floor((c + dc) / size).cast("long").alias("tc"))
    all_ = F.array_distinct(F.array(*[tile(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1)]))
    return all_ if inner else F.array_except(all_, F.array(tile(0, 0)))


_TILED = "tr long, tc long, z binary, label binary, b_r array<long>, b_c array<long>, b_n array<long>, b_z array<double>, p_a array<long>, p_b array<long>, p_level array<double>"


def _placed(size: int, tr: int, tc: int, rows: np.ndarray, cols: np.ndarray, values: np.ndarray, fill: float = np.nan, kind: type = float) -> np.ndarray:
    """Values of cells in and around a tile as an array with a border one cell wide."""
    out = np.full((size + 2, size + 2), fill, kind)
    out[rows - tr * size + 1, cols - tc * size + 1] = values
    return out


def _flooded(cells: DataFrame, size: int) -> DataFrame:
    names = [x.split()[0] for x in _TILED.split(", ")]

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        tr, tc = map(int, key)
        z = _placed(size, tr, tc, rows["r"].to_numpy(), rows["c"].to_numpy(), rows["z"].to_numpy())
        own, valid = z[1:-1, 1:-1], np.isfinite(z)
        if not valid[1:-1, 1:-1].any():
            return pd.DataFrame(columns=names)
        four = valid[2:, 1:-1] & valid[:-2, 1:-1] & valid[1:-1, 2:] & valid[1:-1, :-2]
        rim = valid[1:-1, 1:-1] & ~four
        outer = valid.copy()
        outer[1:-1, 1:-1] = False
        edge = valid[1:-1, 1:-1] & np.any([outer[1 + a : 1 + a + size, 1 + b : 1 + b + size] for a, b in windows.MOVES.values()], axis=0)
        filled, label, passes = _floored(own, rim, edge)
        padded = z.copy()
        padded[1:-1, 1:-1] = filled
        r, c = np.nonzero(edge)
        pairs = list(passes)
        row = (*key, padded.tobytes(), (np.where(rim, 0, label)).astype(np.int32).tobytes(), r + tr * size, c + tc * size, label[r, c].astype(np.int64), own[r, c], [a for a, _ in pairs], [b for _, b in pairs], [passes[p] for p in pairs])
        return pd.DataFrame([row], columns=names)

    inside = cells.where("z is not null and not isnan(z)").select(F.col("r").cast("long"), F.col("c").cast("long"), F.col("z").cast("double"))
    met = inside.withColumn("_t", F.explode(_border(F.col("r"), F.col("c"), size, True))).select("_t.tr", "_t.tc", "r", "c", "z")
    return met.groupBy("tr", "tc").applyInPandas(run, _TILED)


def _levels(tiles: DataFrame) -> DataFrame:
    """(id, level) of all labels that do not reach the rim by themselves."""
    inner = tiles.select("tr", "tc", F.explode(F.arrays_zip("p_a", "p_b", "p_level")).alias("p"))
    inner = inner.select(_label(F.col("tr"), F.col("tc"), F.col("p.p_a")).alias("a"), _label(F.col("tr"), F.col("tc"), F.col("p.p_b")).alias("b"), F.col("p.p_level").alias("level"))
    border = tiles.select("tr", "tc", F.explode(F.arrays_zip("b_r", "b_c", "b_n", "b_z")).alias("p"))
    border = border.select(F.col("p.b_r").alias("r"), F.col("p.b_c").alias("c"), _label(F.col("tr"), F.col("tc"), F.col("p.b_n")).alias("id"), F.col("p.b_z").alias("z"), (F.col("tr") * 2**21 + F.col("tc")).alias("tile"))
    across = windows.neighbours(border, columns=("id", "z", "tile")).where("n_tile <> tile").select(F.col("id").alias("a"), F.col("n_id").alias("b"), F.greatest("z", "n_z").alias("level"))
    return graph.minimax(inner.unionByName(across), _OUT)


def _rows(tiles: DataFrame, more: str, made: Callable[[tuple], pd.DataFrame]) -> DataFrame:
    """One row a tile from one row a tile, in Arrow batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                yield made(row)

    return tiles.mapInPandas(run, more)


def _array(data: bytes, size: int, kind: type = float) -> np.ndarray:
    n = size + 2 if kind is float else size
    return np.frombuffer(data, kind).reshape(n, n)


def drained(cells: DataFrame, size: int = TILE) -> DataFrame:
    """Cells (r, c, z) of one grid, r and c from 0, with filled, code and the cell below, n_r and n_c (null where water leaves).

    Cells without a value are left out. ``z`` and ``filled`` are doubles.
    """
    rounds = Rounds(cells.sparkSession, "drainage")
    tiles = rounds.keep("tiles", _flooded(cells, size))
    levels = _levels(tiles)
    raised = levels.select(F.floor(F.col("id") / 2**41).alias("tr"), (F.floor(F.col("id") / 2**20) % 2**21).alias("tc"), (F.col("id") % 2**20).alias("n"), "level").groupBy("tr", "tc").agg(F.collect_list(F.struct("n", "level")).alias("raised"))

    def fill(row) -> pd.DataFrame:
        z, label = _array(row.z, size).copy(), _array(row.label, size, np.int32)
        lift = np.full(max(int(label.max()), 0) + 1, -np.inf)
        for x in row.raised if row.raised is not None else ():
            lift[x["n"]] = x["level"]
        own = z[1:-1, 1:-1]
        own[label >= 0] = np.maximum(own, lift[np.maximum(label, 0)])[label >= 0]
        r, c = _side(own)
        return pd.DataFrame([(row.tr, row.tc, z.tobytes(), r + row.tr * size, c + row.tc * size, own[r, c])], columns=["tr", "tc", "z", "b_r", "b_c", "b_v"])

    schema = "tr long, tc long, z binary, b_r array<long>, b_c array<long>, b_v array<double>"
    filled = rounds.keep("filled", _rows(tiles.select("tr", "tc", "z", "label").join(raised, ["tr", "tc"], "left"), schema, fill))

    def around(told: DataFrame) -> DataFrame:
        """What each tile hears from the border cells of its neighbours."""
        each = told.select(F.explode(F.arrays_zip("b_r", "b_c", "b_v")).alias("b")).select("b.b_r", "b.b_c", "b.b_v")
        each = each.withColumn("_t", F.explode(_border(F.col("b_r"), F.col("b_c"), size, False)))
        return each.groupBy("_t.tr", "_t.tc").agg(F.collect_list(F.struct("b_r", "b_c", "b_v")).alias("heard"))

    def heard(row, fill: float, kind: type) -> np.ndarray:
        said = row.heard if row.heard is not None else ()
        r, c, v = ([x[k] for x in said] for k in ("b_r", "b_c", "b_v"))
        return _placed(size, row.tr, row.tc, np.array(r, np.int64), np.array(c, np.int64), np.array(v, kind), fill, kind)

    def turn(row) -> pd.DataFrame:
        z = _array(row.z, size).copy()
        hull = heard(row, np.nan, float)
        hull[1:-1, 1:-1] = z[1:-1, 1:-1]
        return settled(row, hull, _rim(hull), None, True)

    def settle(row) -> pd.DataFrame:
        hull = _array(row.z, size)
        return settled(row, hull, _rim(hull), heard(row, hydro.UNKNOWN, np.int32), False, _array(row.ways, size, np.int32))

    def settled(row, hull: np.ndarray, rim: np.ndarray, outside: np.ndarray | None, first: bool, before: np.ndarray | None = None) -> pd.DataFrame:
        codes, ways = hydro.directions(hull, rim, outside)
        r, c = _side(hull[1:-1, 1:-1])
        waits = bool((ways[r, c] > 0).any())  # flats at the border may still find shorter ways
        changed = first or bool((ways != before).any())
        return pd.DataFrame([(row.tr, row.tc, hull.tobytes(), codes.tobytes(), ways.astype(np.int32).tobytes(), waits, changed, r + row.tr * size, c + row.tc * size, ways[r, c].astype(np.int64))], columns=names)

    schema = "tr long, tc long, z binary, codes binary, ways binary, waits boolean, changed boolean, b_r array<long>, b_c array<long>, b_v array<long>"
    names = [x.split()[0] for x in schema.split(", ")]
    state = rounds.append("turned", _rows(filled.select("tr", "tc", "z").join(around(filled), ["tr", "tc"], "left"), schema, turn))
    still, moving = rounds.keep("still", state.where("not waits")), rounds.keep("moving", state.where("waits"))
    rounds.close("still", "moving", "tiles")
    while not moving.where("changed").isEmpty():
        told = around(still.select("b_r", "b_c", "b_v").unionByName(moving.select("b_r", "b_c", "b_v")))
        moving = rounds.keep("moving", _rows(moving.select("tr", "tc", "z", "ways").join(told, ["tr", "tc"], "left"), schema, settle))

    def cells_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        move = np.array([(0, 0)] + [windows.MOVES[k] for k in range(1, 9)])
        for batch in batches:
            for row in batch.itertuples(index=False):
                z = _array(row.z, size)[1:-1, 1:-1]
                code = np.frombuffer(row.codes, np.int8).reshape(size, size)
                r, c = np.nonzero(np.isfinite(z))
                k = code[r, c]
                at = np.stack([r + row.tr * size, c + row.tc * size], 1)
                down = np.where(k[:, None] > 0, at + move[k], -1)
                yield pd.DataFrame({"r": at[:, 0], "c": at[:, 1], "filled": z[r, c], "code": k.astype(np.int32), "n_r": pd.Series(down[:, 0], dtype="Int64").where(k > 0), "n_c": pd.Series(down[:, 1], dtype="Int64").where(k > 0)})

    done = still.select("tr", "tc", "z", "codes").unionByName(moving.select("tr", "tc", "z", "codes"))
    # rows of cells are far larger than the files of tiles by which Spark would choose to broadcast them
    return done.mapInPandas(cells_of, "r long, c long, filled double, code int, n_r long, n_c long").hint("merge")


def _side(own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cells with a value along the sides of a tile."""
    side = np.isfinite(own)
    side[1:-1, 1:-1] = False
    return np.nonzero(side)


def _rim(hull: np.ndarray) -> np.ndarray:
    """Cells with a value of which one of four neighbours has none."""
    valid = np.isfinite(hull)
    out = np.zeros_like(valid)
    out[1:-1, 1:-1] = valid[1:-1, 1:-1] & ~(valid[2:, 1:-1] & valid[:-2, 1:-1] & valid[1:-1, 2:] & valid[1:-1, :-2])
    return out


def place(r: Column | str = "r", c: Column | str = "c") -> Column:
    """A cell's number: its row in the upper, its column in the lower half."""
    r, c = (F.col(x) if isinstance(x, str) else x for x in (r, c))
    return (F.shiftleft(r.cast("long"), 32) + c).alias("id")


def accumulated(ways: DataFrame) -> DataFrame:
    """``drained`` cells with acc: the cells through each, negative where one of the first or last row or column of the grid is among them."""
    size = ways.agg(F.max("r").alias("_h"), F.max("c").alias("_w"))  # one row
    rim = (F.col("r") == 0) | (F.col("c") == 0) | (F.col("r") == F.col("_h")) | (F.col("c") == F.col("_w"))
    rounds = Rounds(ways.sparkSession, "accumulated")
    # written, as a join with one row of no bytes has no bytes either to Spark, which would broadcast all cells
    rows = rounds.keep("rows", ways.crossJoin(F.broadcast(size)).select(place(), place("n_r", "n_c").alias("down"), rim.cast("long").alias("open")))
    acc = graph.accumulate(rows, ["open"]).select("id", F.when(F.col("open") > 0, -F.col("acc")).otherwise(F.col("acc")).alias("acc"))
    rounds.close()
    return ways.withColumn("id", place()).join(acc, "id").drop("id")


def numbered(ways: DataFrame) -> DataFrame:
    """(id, root, first, size) of all cells of ``accumulated``: those that drain through a cell are those of its root numbered from first to before first + size.

    A cell's number is that of the cell below it, one more, and the sizes of the earlier cells that drain there, at most seven.
    """
    rows = ways.select(place(), place("n_r", "n_c").alias("down"), F.abs("acc").alias("size"))
    earlier = F.sum("size").over(Window.partitionBy("down").orderBy("id").rowsBetween(Window.unboundedPreceding, -1))
    step = rows.where("down is not null").withColumn("step", 1 + F.coalesce(earlier, F.lit(0))).select("id", "down", "step", "size")
    rounds = Rounds(ways.sparkSession, "numbered")
    step = rounds.keep("step", step.unionByName(rows.where("down is null").select("id", "down", F.lit(0).alias("step"), "size")))
    found = graph.pointer_jump(step.select("id", "down", "step")).select("id", "root", F.col("distance").cast("long").alias("first"))
    return found.join(step.select("id", "size"), "id")


def basins(numbers: DataFrame, outlets: DataFrame) -> DataFrame:
    """(key, id) of every cell of every outlet's basin, the outlet (key, id) included; outlets may lie in one another's basins.

    An outlet's range is cut into aligned blocks, at most 126 for each power, and a cell belongs to one block of each power: the two meet in an equi-join.
    """
    return _blocks(outlets.join(numbers, "id"), "key").join(_powers(numbers.select("id", "root", "first")), ["root", "power", "block"]).select("key", "id")


def measured(numbers: DataFrame, outlets: DataFrame, values: DataFrame, names: Sequence[str]) -> DataFrame:
    """(key, cells, and for each name the sum, least and greatest) over each outlet's basin of columns of ``values`` (id, names).

    Values are summed by blocks first, for all outlets together, so nested basins cost no cell twice.
    """
    blocks = _powers(numbers.select("id", "root", "first").join(values, "id"))
    parts = [f(n).alias(f"{n}_{w}") for n in names for f, w in ((F.sum, "sum"), (F.min, "min"), (F.max, "max"))]
    sums = blocks.join(wanted := _blocks(outlets.join(numbers, "id"), "key"), ["root", "power", "block"], "left_semi").groupBy("root", "power", "block").agg(F.count("*").alias("cells"), *parts)
    whole = [f(f"{n}_{w}").alias(f"{n}_{w}") for n in names for f, w in ((F.sum, "sum"), (F.min, "min"), (F.max, "max"))]
    return wanted.join(sums, ["root", "power", "block"]).groupBy("key").agg(F.sum("cells").alias("cells"), *whole)


def _powers(cells: DataFrame) -> DataFrame:
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("power"), F.floor(F.col("first") / _BLOCK**k).alias("block")) for k in range(_POWERS + 1)]))
    return cells.withColumn("_p", each).select(*[c for c in cells.columns if c != "first"], "_p.power", "_p.block")


def _block_of(power: int, block: Column) -> Column:
    return F.struct(F.lit(power).alias("power"), block.alias("block"))


def _blocks(ranges: DataFrame, key: str) -> DataFrame:
    """(key, root, power, block): the largest aligned blocks that make up each range."""
    lo, hi = F.col("first"), F.col("first") + F.col("size")
    up, down = (lambda k: F.ceil(lo / _BLOCK**k)), (lambda k: F.floor(hi / _BLOCK**k))
    parts = []
    for k in range(_POWERS + 1):
        a, b = up(k), down(k)
        if k == _POWERS:
            runs = [(a, b)]
        else:
            over = up(k + 1) < down(k + 1)
            runs = [(a, F.when(over, up(k + 1) * _BLOCK).otherwise(b)), (F.when(over, down(k + 1) * _BLOCK).otherwise(b), b)]
        empty = F.expr("CAST(array() AS array<bigint>)")
        sides = [F.when(x < y, F.sequence(x, y - 1)).otherwise(empty) for x, y in runs]
        parts.append(F.transform(F.concat(*sides), partial(_block_of, k)))
    return ranges.select(key, "root", F.explode(F.concat(*parts)).alias("_b")).select(key, "root", "_b.power", "_b.block")


def descended(ways: DataFrame, starts: DataFrame, cell: float, x0: float = 0.0, y0: float = 0.0, steps: int = hydro.DESCENT_STEPS) -> DataFrame:
    """(key, r, c, nth, distance) of the cell nearest to each target on the way down from its start (key, r, c, x, y): of equally near ones the first.

    ``ways`` has cells with the cells below; x0, y0 is the outer corner of cell (0, 0). A start that is no cell has no row.
    """
    found = graph.ways(ways.select(place(), place("n_r", "n_c").alias("down")), starts.select("key", place()), steps - 1)
    met = found.join(starts.select("key", "x", "y"), "key")
    r, c = F.shiftright("id", 32), F.col("id").bitwiseAND(2**32 - 1)
    dx, dy = x0 + (c + 0.5) * cell - F.col("x"), y0 - (r + 0.5) * cell - F.col("y")
    best = met.select("key", r.alias("r"), c.alias("c"), "nth", (dx * dx + dy * dy).alias("d")).groupBy("key").agg(F.min_by(F.struct("r", "c", "nth", F.sqrt("d").alias("distance")), F.struct("d", "nth")).alias("b"))
    return best.select("key", "b.*")


def delineated(cells: DataFrame, outlets: DataFrame, cell: float, stream_cells: int = hydro.STREAM_CELLS, radius: float = hydro.SNAP_RADIUS, size: int = TILE) -> DataFrame:
    """One row an outlet (key, ox, oy, least) over the cells (r, c, z) of one grid, whose corner lies at (0, 0): the cell it snaps to, its basin's measures, or why it is refused.

    Columns: key, r, c, tier and rung of the snap, cells, area and perimeter of the outline of the largest piece without holes, stability, refusal. All outlets share one
    drainage. Stability is the least overlap by union of the basin with those of the eight outlets one cell away: basins of one forest lie in one
    another or apart, so the overlap is the ratio of their sizes or nothing. An outlet without a cell near it is refused.
    """
    rounds = Rounds(cells.sparkSession, "delineated")
    ways = rounds.keep("ways", accumulated(drained(cells, size)))
    numbers = rounds.keep("numbers", numbered(ways))
    moves = F.array(*[F.struct(F.lit(n).alias("way"), F.lit(float(dc * cell)).alias("dx"), F.lit(float(dr * cell)).alias("dy")) for n, (dr, dc) in enumerate([(0, 0), *windows.MOVES.values()])])
    tried = outlets.withColumn("_m", F.explode(moves)).select(F.struct("key", "_m.way").alias("basin_id"), (F.col("ox") + F.col("_m.dx")).alias("ox"), (F.col("oy") - F.col("_m.dy")).alias("oy"), "least")
    snapped = hydro.snapped(ways.select("r", "c", "acc", (F.abs("acc") >= stream_cells).alias("channel")), tried, cell, radius)
    met = snapped.withColumn("id", place()).join(numbers, "id").select("basin_id.key", "basin_id.way", "r", "c", "tier", "rung", "id", "root", "first", "size")
    met = rounds.keep("met", met)
    own = met.where("way = 0").drop("way")
    near = met.where("way > 0").select("key", F.col("root").alias("_root"), F.col("first").alias("_first"), F.col("size").alias("_size"))
    inside = lambda a, b: (F.col(f"{b}first") >= F.col(f"{a}first")) & (F.col(f"{b}first") < F.col(f"{a}first") + F.col(f"{a}size"))
    over = F.when((F.col("root") == F.col("_root")) & (inside("", "_") | inside("_", "")), F.least("size", "_size") / F.greatest("size", "_size")).otherwise(0.0)
    # a neighbour whose own basin would be refused for its size tells nothing
    steady = own.join(near, "key").where(F.col("_size") >= hydro.LEAST_CELLS).groupBy("key").agg(F.min(over).alias("stability"))
    masks = basins(numbers, own.select("key", "id")).select("key", F.shiftright("id", 32).alias("r"), F.col("id").bitwiseAND(2**32 - 1).alias("c"))
    shape = outlines.measures(outlines.largest(outlines.rings(masks)), cell).select("key", "area", "perimeter")
    rows = outlets.select("key").join(own.drop("id", "root", "first"), "key", "left").join(steady, "key", "left").join(shape, "key", "left")
    expected = F.col("size") * cell * cell
    refusal = (
        F.when(F.col("size").isNull(), "the outlet lies outside the grid")
        .when(F.col("area") < hydro.LEAST_SHARE * expected, "too small a part of what drains there")
        .when(F.col("area") < hydro.LEAST_CELLS * cell * cell, "degenerate basin")
        .when(F.col("stability") < hydro.LEAST_IOU, "unstable outlet")
    )
    return rows.select("key", "r", "c", "tier", "rung", F.col("size").alias("cells"), "area", "perimeter", "stability", refusal.alias("refusal"))
