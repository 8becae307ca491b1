"""Near-duplicates of the pipeline: SimHash groups on five-word shingles, and all pairs of a Jaccard similarity of 0.8 or more.

Fingerprints of five-word shingles are linked by multi-index hashing (``simhash``) at 3 bits. At 0.8, two sets differ in 15 %
of the bits on average (10 of 64), and no table of segments and balls finds that surely: segments of 24 bits with balls of
radius 1 on both sides find 27 % of such pairs each, so 0.99 would take 15 tables and 375 rows a text. What the fingerprints
leave is therefore found by MinHash: ``BANDS`` bands of ``ROWS`` values, of which a pair at 0.8 shares none with probability
3e-6. Every candidate of these is verified on the whole sets. Equal sets are one node before any lookup. In each
bucket all first meet the least member; then those that are still in different components meet each
other, less the pairs that a bitmap proves too far apart: a bit is the parity of the shingles that hash
to it, so bits that differ never outnumber shingles that do.

Defined cases: texts without a word are copies of each other; a text of five words or fewer is one
shingle; rows without doc_id stay unless they are a near copy, and rows of one doc_id are rows like others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillflow.llm import common, simhash

SHINGLE = 5
SIMILARITY = 0.8
BANDS = 32
ROWS = 5
BITS = 512
_SEED = 7
_PAIRS = 1 << 18
_rng = np.random.default_rng(_SEED)
_MUL = _rng.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, BANDS * ROWS, np.uint64)


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of a text."""
    return np.unique(simhash.shingle_hashes(text, SHINGLE))


def near(a: np.ndarray, b: np.ndarray) -> bool:
    common_ = len(np.intersect1d(a, b, assume_unique=True))
    return 10 * common_ >= 8 * (len(a) + len(b) - common_)


def bands(held: np.ndarray) -> list[int]:
    """One signed key for each band."""
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(held), 1 << 11):
        x = held[i : i + (1 << 11)]
        x = x ^ (x >> np.uint64(31))
        low = np.minimum(low, (x[None, :] * _MUL[:, None] + _ADD[:, None]).min(axis=1))
    low = low.reshape(BANDS, ROWS)
    return [xxhash.xxh64_intdigest(low[k].tobytes(), k) - (1 << 63) for k in range(BANDS)]


def bitmap(held: np.ndarray) -> bytes:
    odd = np.bincount((held >> np.uint64(20)) % np.uint64(BITS), minlength=BITS) & 1
    return np.packbits(odd.astype(bool)).tobytes()


def _sid(held: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(held.tobytes(), 1234567) - (1 << 63)


def profiles(docs: DataFrame) -> DataFrame:
    """th (hash of the text), fp (SimHash), sid (name of the shingle set), size, bits and bands of every distinct text."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        cols: list[list] = [[] for _ in range(5)]
        for x in batch.column(1):
            every = simhash.shingle_hashes(x.as_py(), SHINGLE)
            held = np.unique(every)
            for col, v in zip(cols, (simhash.signed(simhash.majority(every)), _sid(held), len(held), bitmap(held), bands(held) if len(held) else [])):
                col.append(v)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()))
        yield pa.record_batch([batch.column(0), *map(pa.array, cols, kinds)], names=["th", "fp", "sid", "size", "bits", "bands"])

    rows = docs.select(F.xxhash64(F.col("text").cast("string")).alias("th"), F.col("text").cast("string"))
    return common.map_arrow(rows, run, "th long, fp long, sid long, size long, bits binary, bands array<long>").dropDuplicates(["th"])


def _verified(pairs: DataFrame, heads: DataFrame, docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """The pairs a, b of sids whose sets are near; texts of the sets at hand are read again. Also returns the paths behind it."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct()
    wanted, one = common.materialize(heads.join(wanted, "sid", "left_semi").select("sid", F.col("th").alias("_th")), "near-wanted")

    def sets(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        yield pa.record_batch([batch.column(0), pa.array([shingles(x.as_py()).tobytes() for x in batch.column(1)], pa.binary())], names=["sid", "held"])

    text = F.col("text").cast("string")
    texts = docs.select(text.alias("text")).join(wanted, F.xxhash64("text") == F.col("_th")).select("sid", "text").dropDuplicates(["sid"])
    held, two = common.materialize(common.map_arrow(texts, sets, "sid long, held binary"), "near-sets")

    def check(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        a, b = (c.to_pylist() for c in batch.columns[2:])
        ok = pa.array([near(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(a, b)], pa.bool_())
        yield pa.record_batch([batch.column(0).filter(ok), batch.column(1).filter(ok)], names=["a", "b"])

    left, right = held.select(F.col("sid").alias("a"), F.col("held").alias("x")), held.select(F.col("sid").alias("b"), F.col("held").alias("y"))
    return common.map_arrow(pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y"), check, "a long, b long"), [one, two]


def _apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of different components in one bucket whose bitmaps allow the similarity; rows are sorted by key."""

    def emit(t: pa.Table) -> Iterator[pa.RecordBatch]:
        key, sid, comp, size = (t.column(k).to_numpy() for k in ("key", "sid", "component", "size"))
        bits = np.frombuffer(b"".join(t.column("bits").to_pylist()), np.uint64).reshape(len(key), -1)
        cut = np.flatnonzero(np.diff(key)) + 1
        for lo, hi in zip(np.r_[0, cut], np.r_[cut, len(key)]):
            for i in range(lo, hi, step := max(1, _PAIRS // (hi - lo))):
                j = min(hi, i + step)
                far = np.zeros((j - i, hi - lo), np.int64)
                for w in range(bits.shape[1]):
                    far += np.bitwise_count(bits[i:j, w][:, None] ^ bits[lo:hi, w])
                x, y = size[i:j][:, None], size[lo:hi]
                ok = (sid[i:j][:, None] < sid[lo:hi]) & (comp[i:j][:, None] != comp[lo:hi]) & (9 * far <= x + y) & (10 * np.minimum(x, y) >= 8 * np.maximum(x, y))
                a, b = np.nonzero(ok)
                if len(a):
                    yield pa.record_batch([pa.array(sid[i + a]), pa.array(sid[lo + b])], names=["a", "b"])

    kept: list[pa.Table] = []
    for batch in common.gathered(batches, 1 << 14):
        if kept and kept[-1].column("key")[-1] == batch.column(0)[-1]:
            kept.append(pa.Table.from_batches([batch]))
            continue
        t = pa.concat_tables([*kept, pa.Table.from_batches([batch])]).combine_chunks()
        last = int(np.searchsorted(t.column("key").to_numpy(), t.column("key")[-1].as_py()))
        if last:
            yield from emit(t.slice(0, last))
        kept = [t.slice(last)]
    if kept:
        yield from emit(pa.concat_tables(kept).combine_chunks())


def components(docs: DataFrame) -> DataFrame:
    """th and component of every distinct text of ``docs``."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    seen, _ = common.materialize(profiles(docs), "near-profile")
    heads, _ = common.materialize(seen.where("size > 0").groupBy("sid").agg(F.min("th").alias("th")), "near-heads")
    entries = seen.join(heads, ["sid", "th"], "left_semi").select("sid", F.explode("bands").alias("key"))
    least = entries.groupBy("key").agg(F.min("sid").alias("a"), F.count("*").alias("n")).where("n > 1").select("key", "a")
    met, _ = common.materialize(entries.join(least, "key"), "near-met")
    stars, _ = common.materialize(met.where("sid <> a").select("a", F.col("sid").alias("b")).distinct(), "near-stars")
    alike, _ = common.materialize(seen.select("fp", "sid").distinct().join(simhash.labels(seen), "fp").select("component", "sid"), "near-alike")
    alike = alike.join(alike.groupBy("component").agg(F.min("sid").alias("a")), "component").where("sid <> a").select("a", F.col("sid").alias("b")).distinct()
    near_stars, used = _verified(stars, heads, docs)
    nodes, first = common.connected_components(near_stars.unionByName(alike), "near-cc")

    placed = met.select("key", "sid").join(nodes.withColumnRenamed("node", "sid"), "sid", "left").select("key", "sid", F.coalesce("component", "sid").alias("component"))
    open_ = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key")
    facts = seen.join(heads, ["sid", "th"], "left_semi").select("sid", "size", "bits")
    rows = placed.join(open_, "key", "left_semi").join(facts, "sid").select("key", "sid", "component", "size", "bits")
    rest = common.in_arrow(rows.repartition(parts, "key").sortWithinPartitions("key"), _apart, "a long, b long").distinct()
    rest, _ = common.materialize(rest.join(stars, ["a", "b"], "left_anti"), "near-rest")
    near_rest, used_later = _verified(rest, heads, docs)
    edges = nodes.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(near_rest)
    nodes, _ = common.connected_components(edges, "near-cc")
    for path in (*used, *used_later, *first):
        common.discard(docs.sparkSession, path)
    return seen.join(nodes, seen.sid == nodes.node, "left").select("th", F.coalesce("component", "sid").alias("component"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` less all but the one of the smallest doc_id (null last) of each component."""
    row, first = common.fresh(docs, "_row", "_first")
    label, _ = common.materialize(components(docs), "near-label")
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").cast("long").alias("id"), common.row_hash(docs).alias("row"))
    heads = docs.select(F.xxhash64(F.col("text").cast("string")).alias("_th"), order.alias("o")).groupBy("_th").agg(F.min("o").alias("o"))
    kept = heads.join(label, F.col("_th") == F.col("th")).groupBy("component").agg(F.min("o").alias("o")).select(F.col("o.row").alias(first))
    return common.one_of_each(docs, kept, row, first)
