"""Prefix trie of conversations: every distinct run of first turns as a node, with what sharing it would save.

Turns become numbers by a dictionary of their digests, so texts are read once and never shuffled. Equal sequences of turns
become one path with the number of its conversations: copies cost one row, however many there are. Their ids are joined in
pieces of at most ``PIECE``, which are hashed in order. Then the paths are dealt out by radix, most significant turn first: a
bucket holds the paths of one prefix; while it holds more than ``local`` turns it is split by the next turn in which its paths
differ (found from its smallest and largest path, so a long common opening takes one round, not one a turn). Splitting
emits the nodes of that opening. Buckets that fit are finished each in one task by multikey quicksort, whose parts of equal
turns are the nodes. Sums go up in the task inside a bucket, and by a join for each round above.

The dictionary's most frequent turns (each at least one of ``HOT`` rows, so fewer than ``HOT``) are broadcast, all others
joined, and the split prefixes are broadcast only up to ``FEW``; so no turn, prefix or group of copies gathers in one
task. A conversation is one row of turn numbers (12 bytes a turn).

Defined cases: turns of one number are ordered by their digests, so any order of rows gives the same trie; null roles and texts
count as empty; rows without conv_id belong to no conversation and are left out; repeated rows are repeated turns; of a negative conv_id the remainder is negative, as in SQL; an empty
table has no node, not even the root; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rillflow.llm import common

#: Turns of a bucket that one task finishes.
LOCAL = 100_000
#: A turn is frequent from this part of all rows on.
HOT = 2000
#: Ids of conversations joined in one piece: those with equal ``conv_id >> 14``.
PIECE = 14
#: Split prefixes of a round that are broadcast, at most.
FEW = 20_000

_NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
_NONE = hashlib.sha256(b"").hexdigest()


def sequences(conversations: DataFrame) -> tuple[DataFrame, list[str]]:
    """(conv_id, turns) of every conversation, turns an array of (id, size) in order, size in code points; also the paths of the tables behind it."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256))
    keyed = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), digest.alias("key"), F.char_length(text).alias("size"))
    rows, rows_at = common.materialize(keyed, "trie-turns")
    counted, words_at = common.materialize(rows.groupBy("key").agg(F.count("*").alias("n")).withColumn("id", F.monotonically_increasing_id()), "trie-dictionary")
    often = F.col("n") * HOT > rows.count()
    hot, rest = counted.where(often).select("key", "id"), counted.where(~often).select("key", "id")
    marked = rows.join(F.broadcast(hot), "key", "left")
    coded = marked.where("id IS NOT NULL").unionByName(marked.where("id IS NULL").drop("id").join(rest, "key"))
    each = coded.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "key", "id", "size"))).alias("turns"))
    return each.select("conv_id", F.transform("turns", lambda t: F.struct(t["id"].alias("id"), t["size"].alias("size"))).alias("turns")), [rows_at, words_at]


def _paths(conversations: DataFrame) -> DataFrame:
    """One row for each distinct sequence: ids, sizes, the number of its conversations, the smallest, and the hash of all of them in order."""
    ids = F.transform("turns", lambda t: t["id"])
    keyed = conversations.select("conv_id", ids.alias("ids"), F.transform("turns", lambda t: t["size"]).alias("sizes"))
    keyed = keyed.withColumn("path", F.unhex(F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256)))
    pieces = keyed.groupBy("path", F.shiftright("conv_id", PIECE).alias("piece")).agg(
        F.first("ids").alias("ids"), F.first("sizes").alias("sizes"), F.count("*").alias("n"), F.min("conv_id").alias("least"), F.sort_array(F.collect_list("conv_id")).alias("all")
    )
    pieces = pieces.withColumn("all", F.array_join(F.col("all").cast("array<string>"), ","))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list) -> pa.RecordBatch:
            return pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["ids", "sizes", "n", "least", "ends"])

        kinds = (pa.list_(pa.int64()), pa.list_(pa.int32()), pa.int64(), pa.int64(), pa.string())
        path, row, digest, done = None, [], None, []
        for batch in batches:
            for key, ids, sizes, n, least, ended in zip(*(c.to_pylist() for c in batch.columns)):
                if key != path:
                    if row:
                        done.append((*row, digest.hexdigest()))
                    path, row, digest = key, [ids, sizes, 0, least], hashlib.sha256()
                row[2] += n
                digest.update(("," if row[2] > n else "").encode() + ended.encode())
            if done:
                yield out(done)
                done = []
        if row:
            yield out([(*row, digest.hexdigest())])

    in_order = pieces.repartition("path").sortWithinPartitions("path", "piece").select("path", "ids", "sizes", "n", "least", "all")
    return common.in_arrow(in_order, run, "ids array<long>, sizes array<int>, n long, least long, ends string")


def _grown(paths: list[tuple[list[int], list[int], int, int, str]], depth: int) -> list[list]:
    """Nodes of the paths, which share their first ``depth`` turns: [least, depth, parent, members, children, leaves, saved, hash], a parent before its children.

    Multikey quicksort (Bentley and Sedgewick 1997): a part is split by its paths' turn at one depth into less, equal and more; equal ones are a node.
    """
    nodes: list[list] = []

    def node(d: int, parent: int, path: int) -> int:
        nodes.append([None, d, parent, 0, 0, 0, paths[path][1][d - 1] if d else 0, _NONE])
        return len(nodes) - 1

    def end(at: int, path: int) -> None:
        nodes[at][0], nodes[at][3], nodes[at][7] = paths[path][3], paths[path][2], paths[path][4]

    todo = [(list(range(len(paths))), depth, node(depth, -1, 0))]
    while todo:
        part, d, at = todo.pop()
        if len(part) == 1:
            for k in range(d, len(paths[part[0]][0])):
                at = node(k + 1, at, part[0])
            end(at, part[0])
            continue
        turn = [ids[d] if len(ids := paths[i][0]) > d else -1 for i in part]
        pivot = sorted((turn[0], turn[len(turn) // 2], turn[-1]))[1]
        equal = [i for i, t in zip(part, turn) if t == pivot]
        for side in ([i for i, t in zip(part, turn) if t < pivot], [i for i, t in zip(part, turn) if t > pivot]):
            if side:
                todo.append((side, d, at))
        if pivot < 0:
            end(at, equal[0])
        else:
            todo.append((equal, d + 1, node(d + 1, at, equal[0])))
    saved = [0] * len(nodes)
    for k in range(len(nodes) - 1, -1, -1):
        least, _, parent, members, children, _, size, _ = x = nodes[k]
        x[5] += not children
        saved[k] += (members - 1) * size
        x[6] = saved[k]
        if parent >= 0:
            up = nodes[parent]
            up[0] = least if up[0] is None else min(up[0], least)
            up[3] += members
            up[4] += 1
            up[5] += x[5]
            saved[parent] += saved[k]
    return nodes


def _finish(ready: DataFrame) -> DataFrame:
    """Nodes of all buckets that fit one task; ``top`` marks a bucket's own node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held, out = None, [], [[] for _ in range(10)]

        def emit() -> None:
            at, of, _ = bucket
            nodes = _grown(held, at + 1)
            for k, (least, depth, parent, members, children, leaves, saved, ends) in enumerate(nodes):
                up = nodes[parent][0] if k else (of if at >= 0 else None)
                for column, value in zip(out, (least, depth, up, members, children, leaves, saved, ends, k == 0, at)):
                    column.append(value)

        def flush() -> pa.RecordBatch:
            columns = [pa.array(c, pa.string() if k == 7 else pa.bool_() if k == 8 else pa.int64()) for k, c in enumerate(out)]
            for c in out:
                c.clear()
            return pa.record_batch(columns, names=[*(x.split()[0] for x in _NODE.split(", ")), "top", "at"])

        for batch in batches:
            for at, of, turn, *path in zip(*(c.to_pylist() for c in batch.columns)):
                if (at, of, turn) != bucket:
                    if held:
                        emit()
                        if len(out[0]) > LOCAL:
                            yield flush()
                    bucket, held = (at, of, turn), []
                held.append(path)
        if held:
            emit()
        if out[0]:
            yield flush()

    in_order = ready.repartition("at", "of", "turn").sortWithinPartitions("at", "of", "turn").select("at", "of", "turn", "ids", "sizes", "n", "least", "ends")
    return common.in_arrow(in_order, run, f"{_NODE}, top boolean, at long")


def _shared(a: Column, b: Column) -> Column:
    """How many first elements two arrays have in common."""
    differ = F.filter(F.sequence(F.lit(1), F.greatest(F.size(a), F.size(b))), lambda k: ~F.try_element_at(a, k).eqNullSafe(F.try_element_at(b, k)))
    return F.when(a == b, F.size(a)).otherwise(F.try_element_at(differ, F.lit(1)) - 1)


def trie(conversations: DataFrame, local: int = LOCAL) -> DataFrame:
    """All nodes of the trie of (conv_id, turns): one row a conversation, turns an array of (id, size)."""
    spark = conversations.sparkSession
    rows, at = common.materialize(_paths(conversations).select(F.lit(-1).cast("long").alias("at"), F.lit(0).cast("long").alias("of"), F.lit(0).cast("long").alias("turn"), "*"), "trie-paths")
    behind = [at]
    splits, ready = [], []
    bucket = ["at", "of", "turn"]
    while True:
        load = F.sum(F.size("ids") - F.col("at"))
        stats = rows.groupBy(*bucket).agg(load.alias("load"), F.min(F.struct("ids", "sizes")).alias("low"), F.max("ids").alias("high"), F.sum("n").alias("members"), F.min("least").alias("first"))
        big = stats.where(F.col("load") > local).withColumn("to", _shared(F.col("low.ids"), F.col("high")).cast("long"))
        big, at = common.materialize(big.select(*bucket, "to", "first", "members", F.col("low.sizes").alias("opening")), "trie-split")
        behind.append(at)
        n = big.count()
        if not n:
            ready.append(rows)
            break
        keys = big.select(*bucket, "to", "first")
        keys = F.broadcast(keys) if n <= FEW else keys
        ready.append(rows.join(keys, bucket, "left_anti"))
        inside = rows.join(keys, bucket)
        ended = inside.where("size(ids) = to").select(F.col("to").alias("at"), F.col("first").alias("of"), F.col("ends"))
        splits.append((big, ended))
        further = inside.where("size(ids) > to").select(
            F.col("to").alias("at"), F.col("first").alias("of"), F.element_at("ids", (F.col("to") + 1).cast("int")).alias("turn"), "ids", "sizes", "n", "least", "ends"
        )
        rows, at = common.materialize(further, "trie-bucket")
        behind.append(at)
    whole = ready[0]
    for part in ready[1:]:
        whole = whole.unionByName(part)
    nodes, at = common.materialize(_finish(whole), "trie-nodes")
    out = nodes.drop("top", "at")
    below = nodes.where("top AND at >= 0").select("at", F.col("parent_conv_id").alias("of"), "n_leaves", "saved_tokens")
    for big, ended in reversed(splits):
        made, _ = common.materialize(_opening(big, ended, below), "trie-opening")
        out = out.unionByName(made.select(*out.columns))
        below = below.unionByName(made.where("top AND at >= 0").select("at", "of", "n_leaves", "saved_tokens"))
    for at in behind:
        common.discard(spark, at)
    return out


def _opening(big: DataFrame, ended: DataFrame, below: DataFrame) -> DataFrame:
    """Nodes of the common openings of split buckets, from what lies below the turn at which each splits."""
    kids = below.groupBy("at", "of").agg(F.count("*").alias("kids"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
    names = [F.col("at").alias("to"), F.col("of").alias("first")]
    each = big.join(kids.select(*names, "kids", "leaves", "saved"), ["to", "first"], "left").join(ended.select(*names, "ends"), ["to", "first"], "left")
    each = each.select("*", F.explode(F.sequence(F.col("at") + 1, F.col("to"))).alias("depth"))
    last = F.col("depth") == F.col("to")
    own = F.when(F.col("depth") > 0, (F.col("members") - 1) * F.element_at("opening", F.greatest(F.col("depth"), F.lit(1)).cast("int"))).otherwise(0)
    upward = Window.partitionBy("to", "first").orderBy(F.col("depth").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return each.select(
        F.col("first").alias("conv_id"),
        "depth",
        F.when(F.col("depth") > F.col("at") + 1, F.col("first")).when(F.col("at") >= 0, F.col("of")).alias("parent_conv_id"),
        F.col("members").alias("n_convs"),
        F.when(last, F.coalesce("kids", F.lit(0))).otherwise(1).cast("long").alias("n_children"),
        F.coalesce("leaves", F.lit(1)).cast("long").alias("n_leaves"),
        (F.coalesce("saved", F.lit(0)) + F.sum(own).over(upward)).cast("long").alias("saved_tokens"),
        F.when(last, F.coalesce("ends", F.lit(_NONE))).otherwise(F.lit(_NONE)).alias("ends_sha256"),
        (F.col("depth") == F.col("at") + 1).alias("top"),
        "at",
        "of",
    )


def rebuilt(conversations: DataFrame) -> DataFrame:
    """The contract's conversations: the first turns of one in a hundred, then a conversation's own further ones."""
    h = F.crc32(F.col("conv_id").cast("string")) % 6
    heads = conversations.where("conv_id % 100 = 0").select(F.col("conv_id").alias("base"), F.slice("turns", 1, 5).alias("head"))
    own = conversations.select("conv_id", "turns", (F.col("conv_id") - F.col("conv_id") % 100).alias("base"), h.cast("int").alias("h")).join(heads, "base", "left")
    rest = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(1)))
    return own.select("conv_id", F.concat(F.coalesce(F.slice("head", F.lit(1), F.col("h")), F.slice("turns", 1, 0)), rest).alias("turns"))


def op13_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    made, behind = sequences(common.table(spark, sf_dir, "conversations"))
    out = trie(rebuilt(made))
    for path in behind:
        common.discard(spark, path)
    return out


OP13_SQL = """
WITH coded AS (
  SELECT conv_id, turn, sha256(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))) AS k, length(coalesce(text, '')) AS s
  FROM conversations WHERE conv_id IS NOT NULL
), own AS (
  SELECT conv_id, list({'k': k, 's': s} ORDER BY turn NULLS FIRST, k) AS turns FROM coded GROUP BY conv_id
), hashed AS (
  SELECT *, xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
    lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda y, z: xor(y >> 1, (y & 1) * 3988292384))), 4294967295) % 6 AS h
  FROM own
), rebuilt AS (
  SELECT o.conv_id, list_concat(coalesce(b.turns[1:o.h], o.turns[1:0]), o.turns[o.h + 1:]) AS turns
  FROM hashed o LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 100
), prefix AS (
  SELECT conv_id, d, turns[1:d] AS p, len(turns) AS n FROM rebuilt, unnest(range(0, len(turns) + 1)) AS x(d)
), node AS (
  SELECT d, p, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * coalesce(any_value(p[d].s), 0) AS own,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE n = d), '')) AS ends_sha256
  FROM prefix GROUP BY d, p
), kids AS (
  SELECT d - 1 AS d, p[1:d - 1] AS p, count(*) AS n_children FROM node WHERE d > 0 GROUP BY ALL
), leafy AS (
  SELECT node.*, coalesce(n_children, 0) AS n_children FROM node LEFT JOIN kids USING (d, p)
), above AS (
  SELECT x.d AS d, p[1:x.d] AS p, sum(own) AS saved_tokens, count(*) FILTER (WHERE n_children = 0) AS n_leaves
  FROM leafy, unnest(range(0, leafy.d + 1)) AS x(d) GROUP BY ALL
)
SELECT l.conv_id, l.d AS depth, u.conv_id AS parent_conv_id, l.n_convs, l.n_children, a.n_leaves, CAST(a.saved_tokens AS BIGINT) AS saved_tokens, l.ends_sha256
FROM leafy l JOIN above a USING (d, p) LEFT JOIN node u ON u.d = l.d - 1 AND u.p = l.p[1:l.d - 1]
"""
