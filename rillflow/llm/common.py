"""Shared helpers of the training-data operators: storage, Arrow batches, graph components.

Nothing here keeps state on a machine's own disk: intermediate tables go to the folder named by
``spark.checkpoint.dir``, which every executor sees, so a lost executor costs only a re-read.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts, U+0020 and U+0009 to U+000D; also what ``bytes.split()`` splits at.
WORD = r"[^\x20\x09-\x0D]+"
#: Most rows and bytes of an Arrow batch.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 2000, "spark.sql.execution.arrow.maxBytesPerBatch": 8 << 20}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a folder of this machine's only where none is named and no other machine takes part (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(named)
        full = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toUri()
        return f"{full.getScheme()}://{full.getAuthority() or ''}{full.getPath()}".rstrip("/")
    kept = spark.conf.get("rillflow.shared.dir", None)
    if kept is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        kept = f"file://{tempfile.mkdtemp(prefix='rillflow-')}"
        spark.conf.set("rillflow.shared.dir", kept)
    return kept


def work_dir(spark: SparkSession) -> str:
    """This application's own part of the shared folder."""
    return f"{shared_dir(spark)}/rillflow-{spark.sparkContext.applicationId}"


def clear(spark: SparkSession) -> None:
    """Delete all tables that this application's operators wrote, once no result of theirs is read any more."""
    discard(spark, work_dir(spark))


#: Rows of a file of an iteration's table.
FILE_ROWS = 200_000


def materialize(df: DataFrame, tag: str, rows: int | None = None) -> tuple[DataFrame, str]:
    """Write ``df`` to the shared folder and read it back: the lineage ends here.

    Where a bound of its rows is known, it goes into as few files as they need, not one for each shuffle partition.
    """
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    (df if rows is None else df.coalesce(1 + rows // FILE_ROWS)).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table that ``materialize`` wrote, once nothing reads it any more."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores behind as keep it from clashing with a column of ``df``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def own(df: DataFrame) -> list[str]:
    """The columns of ``df``, quoted."""
    return ["`" + c.replace("`", "``") + "`" for c in df.columns]


def row_hash(df: DataFrame) -> Column:
    """Hash of all columns of a row; nulls count by place, and maps, which Spark does not hash, as JSON."""
    cols = [F.to_json(F.struct(F.col(q).alias("m"))) if "map<" in f.dataType.simpleString() else F.col(q) for q, f in zip(own(df), df.schema.fields)]
    return F.xxhash64(*cols, *(F.col(q).isNull() for q in own(df)))


def one_of_each(docs: DataFrame, kept: DataFrame, row: str, first: str) -> DataFrame:
    """The rows of ``docs`` whose hash is in column ``first`` of ``kept``; of rows equal in all columns, one.

    Equal rows are found by their hashes, so texts move only where a join by hash needs them.
    """
    marked = docs.withColumn(row, row_hash(docs))
    many, _ = materialize(marked.groupBy(F.col(row).alias(first)).count().where("count > 1").select(first), "repeated")
    found = marked.join(kept, F.col(row) == F.col(first), "left_semi")
    single, repeated = (found.join(many, F.col(row) == F.col(first), how) for how in ("left_anti", "left_semi"))
    return single.unionByName(repeated.dropDuplicates([row])).select(*own(docs))


def in_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` in batches that stay small whatever the length of texts; larger settings of the session are lowered."""
    conf = df.sparkSession.conf
    for key, most in BATCH.items():
        held = conf.get(key, None)
        if held is None or not held.isdigit() or not 0 < int(held) <= most:
            conf.set(key, most)
    return df.mapInArrow(fn, schema)


def gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Batches of at least ``rows`` rows, but for the last."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield pa.concat_batches(held)
            held, n = [], 0
    if n:
        yield pa.concat_batches(held)


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` with a function of one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from fn(batch)

    return in_arrow(df, run, schema)


def local_forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest node of each node's component in the graph of the edges a-b over nodes 0 to n-1."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while not np.array_equal(jumped := new[new], new):
            new = jumped
        if np.array_equal(new, label):
            return label
        label = new


def connected_components(edges: DataFrame, tag: str = "components") -> tuple[DataFrame, list[str]]:
    """(node, component) of every node in ``edges`` (columns a, b, long), component the smallest node.

    Alternating large-star and small-star rounds (Kiveris et al., 2014): each round keeps at most as
    many edges as before and ends in stars, in a number of rounds logarithmic in the longest path.
    Neighbourhoods are only ever reduced by ``min``, never collected, and each round is written to
    the shared folder. Also returns the paths that hold the result.
    """
    spark = edges.sparkSession
    flat, path = materialize(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), tag
    )

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())

    seen = mark(flat)
    while seen[0]:
        both = flat.unionByName(flat.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        first = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(first, "u")
            .select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u <> v")
            .distinct()
        )
        flat_next, path_next = materialize(small, tag, seen[0])  # a round never has more edges than the last
        now = mark(flat_next)
        discard(spark, path)
        flat, path = flat_next, path_next
        if now == seen:
            break
        seen = now
    roots = flat.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return flat.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots), [path]
