"""Upstream networks by waves of tiles: only the tiles that the network runs through are read.

Reaches are stored by tile, each in every tile that its box meets. An outlet starts with the tiles around it. A wave follows the
known network upstream until it ends; where it ends at a node that none of the outlet's tiles has brought an inflow to, the tiles at
that node are read next, all outlets' tiles of a wave in one scan that the tile keys prune. A node inside tiles that are read needs no further
one: all its reaches came with them, so without inflow it is a source. The budget is looked at only where more tiles are wanted. What is known is
kept as tables of the shared folder, so outlets over their budget can be taken up again with a larger one.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from itertools import count

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillflow.operators import graph, spatial, windows
from rillflow.plans import basin
from rillflow.session import Rounds

# The reach of an outlet and the most waves.
RADIUS, WAVES = 50.0, 200
#: Tiles of a wave that are broadcast, so that they prune the scan, at most.
FEW = 50_000

Reader = Callable[[DataFrame], DataFrame]


def store(reaches: DataFrame, path: str, size: float) -> None:
    """Write reaches once for each tile that their box meets, one folder a tile."""
    spatial.with_tiles(reaches, size).repartition("tx", "ty").write.partitionBy("tx", "ty").parquet(path)


def stored(spark: SparkSession, path: str) -> Reader:
    """Reads the reaches of wanted tiles (wave, tx, ty): the folders are listed once, and a wave's scan is pruned to its own."""
    layer = spark.read.parquet(path)

    def read(wanted: DataFrame) -> DataFrame:
        n = wanted.count()
        return layer.join(F.broadcast(wanted) if n <= FEW else wanted, ["tx", "ty"]).drop("wave")

    return read


@dataclass
class State:
    """What is known of all outlets: tiles wanted (basin_id, tx, ty, wave, full: not read, the budget being reached; with the reach id that ends there), reaches read (basin_id and theirs), those found upstream (basin_id, id)."""

    rounds: Rounds
    seeds: DataFrame
    wave: int

    @property
    def wanted(self) -> DataFrame:
        return self.rounds.all("wanted")

    @property
    def tiles(self) -> DataFrame:
        return self.wanted.where("not full").select("basin_id", "tx", "ty").distinct()

    @property
    def known(self) -> DataFrame:
        return self.rounds.all("known")

    @property
    def found(self) -> DataFrame:
        return self.rounds.all("found").distinct()


def _own(rows: DataFrame) -> DataFrame:
    """Reaches with ids and nodes that tell the outlets' networks apart."""
    name = lambda c: F.when(F.col(c).isNotNull(), F.concat_ws("|", F.col("basin_id").cast("string"), F.col(c)))
    return graph.oriented(rows.withColumns({"own": F.col("id"), "id": F.struct("basin_id", "id"), "ini": name("ini"), "fin": name("fin")}))


def _fetch(state: State, read: Reader) -> DataFrame:
    """Read the tiles wanted in this wave, and note each outlet's reaches that are new."""
    tiles = state.wanted.where((F.col("wave") == state.wave) & ~F.col("full")).select("basin_id", "wave", "tx", "ty").distinct()
    rows = read(tiles.select("wave", "tx", "ty").distinct())
    rows = rows.join(tiles.drop("wave"), ["tx", "ty"]).drop("tx", "ty").dropDuplicates(["basin_id", "id"])
    if "known" in state.rounds.paths:
        rows = rows.join(state.known.select("basin_id", "id"), ["basin_id", "id"], "left_anti")
    return state.rounds.append("known", rows)


def _reached(own: DataFrame, found: DataFrame, fresh: DataFrame) -> DataFrame:
    """Found reaches (basin_id, id) whose upper node has got a new inflow."""
    into = graph.inflows(_own(fresh)).select("node").distinct()
    heads = graph.heads(own.join(found.select(F.struct("basin_id", "id").alias("id")), "id", "left_semi"))
    return heads.join(into, "node", "left_semi").select("id").distinct().select("id.basin_id", "id.id")


def start(outlets: DataFrame, read: Reader, size: float, radius: float = RADIUS) -> State:
    """The state of outlets (basin_id, x, y) with the tiles around them and the reaches they snap to."""
    rounds = Rounds(outlets.sparkSession, "waves")
    around = outlets.select("basin_id", *[(F.col(c) + s * radius).alias(n) for n, c, s in (("xmin", "x", -1), ("ymin", "y", -1), ("xmax", "x", 1), ("ymax", "y", 1))])
    state = State(rounds, outlets, 0)
    rounds.append("wanted", spatial.with_tiles(around, size).select("basin_id", F.lit(None).cast("long").alias("id"), "tx", "ty", F.lit(0).alias("wave"), F.lit(False).alias("full")))
    _fetch(state, read)
    near = basin.nearest_reach(outlets, state.known.drop("basin_id").dropDuplicates(["id"]), radius)
    state.seeds = rounds.keep("seeds", near.select("basin_id", F.col("id").cast("long").alias("id"), "distance"))
    rounds.append("found", state.seeds.select("basin_id", "id"))
    return state


def extend(state: State, read: Reader, size: float, budget: int | None = basin.REACHES) -> DataFrame:
    """Follow all outlets of ``state`` upstream; (basin_id, n_reaches, tiles, loaded, refusal) of each.

    An outlet that wants more tiles while it holds ``budget`` reaches or more is refused and stays as it is: a call with a larger budget goes on from there.
    Without one (None) every network is followed to its end, in as many waves as it takes.
    """
    rounds, fresh = state.rounds, None
    stopped = state.wanted.where("full").select("basin_id", "id").distinct()
    ends = rounds.keep("ends", state.seeds.select("basin_id", "id") if state.wave == 0 else stopped)  # reaches from which to go on
    if state.wave:
        rounds.keep("wanted", state.wanted.where("not full"))
    active = ends.select("basin_id").distinct()
    for _ in count() if budget is None else range(WAVES):
        own = _own(state.known.join(active, "basin_id"))
        if fresh is not None:
            ends = _reached(own, state.found.join(active, "basin_id", "left_semi"), fresh)
        reached = graph.upstream_closure(own, ends.select("basin_id", F.struct("basin_id", "id").alias("id")))
        rounds.append("found", reached.select("basin_id", "id.id").join(rounds.all("found"), ["basin_id", "id"], "left_anti"))
        stuck = graph.dead_ends(own).join(state.found.select(F.struct("basin_id", "id").alias("id")), "id", "left_semi")
        first = F.col("up_node").eqNullSafe(F.col("ini"))
        spot = stuck.select("basin_id", F.col("own").alias("id"), F.when(first, F.col("x_ini")).otherwise(F.col("x_fin")).alias("x"), F.when(first, F.col("y_ini")).otherwise(F.col("y_fin")).alias("y"))
        at = spot.withColumn("t", F.explode(windows.touching_tiles(F.col("x"), F.col("y"), size))).select("basin_id", "id", "t.tx", "t.ty")
        full = state.known.groupBy("basin_id").agg((F.lit(False) if budget is None else F.count("*") >= budget).alias("full"))
        state.wave += 1
        lacking = at.join(state.tiles, ["basin_id", "tx", "ty"], "left_anti").join(full, "basin_id")
        want = rounds.append("wanted", lacking.select("basin_id", F.col("id").cast("long").alias("id"), "tx", "ty", F.lit(state.wave).alias("wave"), "full"))
        active = want.where("not full").select("basin_id").distinct()
        if active.isEmpty():
            break
        fresh = _fetch(state, read)
    number = lambda rows, name: rows.groupBy("basin_id").agg(F.count("*").alias(name))
    out = number(state.found, "n_reaches").join(number(state.tiles, "tiles"), "basin_id").join(number(state.known, "loaded"), "basin_id")
    over = state.wanted.where("full").select("basin_id").distinct().withColumn("refusal", F.lit(f"more tiles wanted at the budget of {budget} reaches"))
    return out.join(over, "basin_id", "left")
