"""SimHash near-duplicates by multi-index hashing.

Fingerprints are linked when they differ in at most ``radius`` = 3 of 64 bits. A fingerprint is cut
into two 32-bit segments; of two linked fingerprints, one segment differs in at most one bit. So
every distinct fingerprint is entered in a table under both segments, and looks up the Hamming ball
of radius one around each (each pair once: from the side whose differing bit is clear). What is
found is verified on all 64 bits. Equal texts have one fingerprint, so groups of copies are one row
before any lookup; and each task folds the links that it verifies, block by block, into a spanning forest, so even a
segment that thousands of near copies share holds and emits no more rows than it has fingerprints.

Defined cases: a null or empty text, or one of white space only, has fingerprint zero and links like
any other; rows with a null doc_id get a fingerprint, but cannot name a component; repeated rows
are kept, each with the same result; an empty table gives an empty result; extra columns are ignored.
``keep_one`` tells rows apart by all their columns: of a group, the row of the smallest doc_id stays (null last, then the smallest text).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillflow.llm import common

SHINGLE = 3
SEED = 42
RADIUS = 3
#: Pairs of one array; the arrays of a task stay small, however large its groups.
_PAIRS = 1 << 18


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """XXH64 of every word shingle of a text, in order and with repeats; of the whole sequence, if it is shorter; none without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([digest(joined, SEED)], np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: 1 - shingle].tolist()
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist())), np.uint64, len(starts))


def majority(hashes: np.ndarray) -> int:
    """The fingerprint: bits that are set in over half the hashes."""
    count = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = hashes[i : i + (1 << 16)].astype(">u8")
        count += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(2 * count > len(hashes)).tobytes(), "big")


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of the word shingles of a text."""
    return majority(shingle_hashes(text, shingle))


def signed(fp: int) -> int:
    return fp - (1 << 64) if fp >> 63 else fp


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long, of every row."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        fp = np.fromiter((fingerprint(x.as_py(), shingle) for x in batch.column(1)), np.uint64, batch.num_rows)
        yield pa.record_batch([batch.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return common.map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, fp long")


def _probes(fps: DataFrame) -> DataFrame:
    """key (segment number above 32 bits of segment), fp, probe: false for table entries."""
    parts = F.array(*(F.expr(f"(shiftrightunsigned(fp, {32 * s}) & 4294967295L) | {s << 32}L") for s in (0, 1)))
    ball = F.expr("transform(filter(sequence(0, 31), b -> (k & shiftleft(1L, b)) = 0), b -> k | shiftleft(1L, b))")
    cut = fps.select("fp", F.explode(parts).alias("k"))
    return cut.select("fp", F.explode(F.concat(F.array("k"), ball)).alias("key"), "k").select("key", "fp", (F.col("key") != F.col("k")).alias("probe"))


def _masks(most: int) -> np.ndarray:
    """All 32-bit words of at most ``most`` set bits."""
    out = ball = {0}
    for _ in range(most):
        ball = {m | 1 << b for m in ball for b in range(32)}
        out = out | ball
    return np.array(sorted(out), np.uint64)


def _big_group(fp: np.ndarray, probe: np.ndarray, segment: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links of one key in time linear in its rows: each row looks up the ball around its other segment."""
    shift, held = np.uint64(32 * (1 - segment)), np.unique(fp[~probe])
    other = (held >> shift) & np.uint64(0xFFFFFFFF)
    order = np.argsort(other)
    other, held = other[order], held[order]
    for rows, most in ((fp[~probe], RADIUS), (fp[probe], RADIUS - 1)):
        masks = _masks(most)
        for i in range(0, len(rows), step := max(1, _PAIRS // len(masks))):
            look = (((rows[i : i + step] >> shift) & np.uint64(0xFFFFFFFF))[:, None] ^ masks).ravel()
            at = np.searchsorted(other, look)
            found = np.flatnonzero((at < len(other)) & (other[np.minimum(at, len(other) - 1)] == look))
            yield rows[i + found // len(masks)], held[at[found]]


def _mid_group(fp: np.ndarray, probe: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links of one key, its table entries against all its rows, some entries at a time."""
    held = fp[~probe]
    for i in range(0, len(held), step := max(1, _PAIRS // len(fp))):
        part = held[i : i + step]
        a, b = np.nonzero(np.bitwise_count(part[:, None] ^ fp) <= RADIUS)
        other = part[a] != fp[b]
        yield part[a[other]], fp[b[other]]


def _links(key: np.ndarray, fp: np.ndarray, probe: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Verified links of whole groups of rows sorted by key."""
    cut = np.flatnonzero(np.diff(key)) + 1
    start, end = np.r_[0, cut], np.r_[cut, len(key)]
    held = np.add.reduceat((~probe).astype(np.int64), start)
    work = held * (end - start)
    for g in np.flatnonzero(work > _PAIRS):
        own, flag = fp[start[g] : end[g]], probe[start[g] : end[g]]
        ball = held[g] * 5489 + (len(own) - held[g]) * 529  # words of at most 3 and 2 bits of 32
        yield from _big_group(own, flag, int(key[start[g]] >> 32)) if 4 * ball < work[g] else _mid_group(own, flag)
    fit = np.flatnonzero((held > 0) & (end - start > 1) & (work <= _PAIRS))
    many = np.cumsum(work[fit])
    for lot in np.split(fit, np.searchsorted(many, np.arange(_PAIRS, many[-1], _PAIRS)) if len(fit) else []):
        if not len(lot):
            continue
        size = (end - start)[lot]
        rows = np.repeat(start[lot] - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
        group = np.repeat(np.arange(len(lot)), size)
        mine = ~probe[rows]
        a, g = rows[mine], group[mine]
        span = size[g]
        left = np.repeat(a, span)
        right = np.repeat(start[lot][g] - np.r_[0, np.cumsum(span)[:-1]], span) + np.arange(span.sum())
        near = (left != right) & (np.bitwise_count(fp[left] ^ fp[right]) <= RADIUS)
        yield fp[left[near]], fp[right[near]]


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within a partition sorted by key, as forest edges; the last, open key of a batch waits for the next."""
    kept = [np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, bool)]

    def emit(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if not len(cols[0]):
            return
        nodes = np.unique(cols[1])
        root = np.arange(len(nodes))
        for a, b in _links(*cols):  # each block of links joins trees of the forest, and is forgotten
            if len(a):
                root = root[common.local_forest(root[np.searchsorted(nodes, a)], root[np.searchsorted(nodes, b)], len(nodes))[root]]
                while not np.array_equal(jumped := root[root], root):
                    root = jumped
        moved = np.flatnonzero(root != np.arange(len(nodes)))
        if len(moved):
            yield pa.record_batch([pa.array(nodes[moved].view(np.int64)), pa.array(nodes[root[moved]].view(np.int64))], names=["a", "b"])

    held = []
    for batch in common.gathered(batches, 1 << 16):
        key = batch.column(0).to_numpy()
        cols = [key, batch.column(1).to_numpy().view(np.uint64), batch.column(2).to_numpy(zero_copy_only=False)]
        if len(kept[0]) and kept[0][0] == key[-1]:
            held.append(cols)
            continue
        cols = [np.concatenate([k, *(h[i] for h in held), c]) for i, (k, c) in enumerate(zip(kept, cols))]
        held, last = [], np.searchsorted(cols[0], cols[0][-1])
        kept = [c[last:] for c in cols]
        yield from emit([c[:last] for c in cols])
    yield from emit([np.concatenate([k, *(h[i] for h in held)]) for i, k in enumerate(kept)])


def labels(fps: DataFrame) -> DataFrame:
    """fp and component, the smallest fingerprint that links reach, of every distinct ``fp``."""
    parts = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    groups = fps.select("fp").distinct()
    edges = common.in_arrow(_probes(groups).repartition(parts, "key").sortWithinPartitions("key"), _verify, "a long, b long")
    nodes, _ = common.connected_components(edges, "simhash-cc")
    return groups.join(nodes, groups.fp == nodes.node, "left").select("fp", F.coalesce("component", "fp").alias("component"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp and component_id, the smallest doc_id that links reach, of every row of ``docs``."""
    fps, _ = common.materialize(fingerprints(docs, shingle), "simhash-fp")
    groups = fps.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    member, _ = common.materialize(groups.join(labels(fps), "fp"), "simhash-member")
    least = member.groupBy("component").agg(F.min("rep").alias("component_id"))
    label = member.select("fp", "component").join(least, "component").select("fp", "component_id")
    return fps.join(label, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """The rows of ``docs`` less all but one of each group of near-duplicates.

    The row of the smallest doc_id stays (null last, then by the hash of all columns), so no group is lost for want of an id.
    """
    row, first = common.fresh(docs, "_row", "_first")

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        made = np.fromiter((fingerprint(x.as_py(), shingle) for x in batch.column(2)), np.uint64, batch.num_rows)
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(made.view(np.int64))], names=["row", "doc_id", "fp"])

    rows = docs.select(common.row_hash(docs).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    fps, _ = common.materialize(common.map_arrow(rows, run, "row long, doc_id long, fp long"), "simhash-rows")
    order = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("o")
    best, _ = common.materialize(fps.groupBy("fp").agg(order), "simhash-best")
    kept = best.join(labels(best), "fp").groupBy("component").agg(F.min("o").alias("o")).select(F.col("o.row").alias(first))
    return common.one_of_each(docs, kept, row, first)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
