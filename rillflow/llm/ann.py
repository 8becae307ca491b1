"""Nearest neighbours by inner product over randomly rotated one-bit codes.

A vector v is stored once, in a table of codes: |v| (over its largest component, and that), the signs of the rotated unit vector packed into bits, and a correction:
the inner product a of the unit vector with its own sign vector. The rotation leads into D dimensions,
a few times those of the vectors up to ``LONGEST``: short vectors get longer codes, as the error falls
with D. A query q, rotated to y, is rounded to ``PLANES`` bits a dimension, kept as bit planes. So <s, y>, s the signs, is a
weighted sum of counts of the bits that a code and a plane have in common, and <v, q> is estimated as |v| <s, y> / a,
from packed bits and two scalars. What the code does not see is bounded by |v| |y| ``EPSILON`` sqrt((1 - a^2) / (a^2 (D - 1))), what rounding
took by |v| ``EPSILON`` |y - rounded| / (a sqrt(D)), taken together as independent errors; the bound fails with
a probability of about exp(-EPSILON^2 / 2). A candidate is reranked on the original vectors, in double precision and in
the order of the dimensions, if its estimate plus bound reaches the score of the query's k-th best so far.

The queries are taken in blocks of at most ``BLOCK_BYTES``, each broadcast once; every block is held
against all codes where they lie, without a shuffle. A task keeps k rows of each query, and the tasks'
rows meet in a ranking per query.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components take no part,
nor do rows without vec_id; a query meets the vectors of its own length only; every row is a candidate, also one of a repeated
vec_id, and a query leaves out its own row alone; ties go to the smaller vec_id; components of any finite size count, and products beyond the largest number are infinite, or no number, which comes first, as in SQL; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rillflow.llm import common

K = 20
EPSILON = 5.0
PLANES = 4
#: Bits of a code: WIDER times the dimensions, up to LONGEST, and one for each dimension at least.
WIDER, LONGEST = 8, 1024
BLOCK_BYTES = 32 << 20
#: Blocks whose results one plan joins.
UNION = 16
_ROWS = 2048
#: Pairs of one pass over the planes, so that its arrays stay in a processor's cache.
_CELLS = 1 << 15
_SEED = 7


@cache
def rotation(dim: int) -> np.ndarray:
    """A random rotation into the dimensions of the code, the same for all: orthonormal rows from a seeded Gaussian matrix."""
    bits = max(dim, min(WIDER * dim, LONGEST))
    q, r = np.linalg.qr(np.random.default_rng(_SEED).standard_normal((bits, dim)))
    return (q * np.sign(np.diag(r))).T


def scaled(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors over their largest component, and that: no norm of the former overflows or vanishes."""
    largest = np.abs(vectors).max(axis=1)
    return vectors / largest[:, None], largest


def encode(vectors: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sign bits packed into words of 64; norms over the largest component, corrections a, and the largest components."""
    part, largest = scaled(vectors)
    norm = np.linalg.norm(part, axis=1)
    unit = (part / norm[:, None]) @ turn
    return _packed(unit > 0), norm, np.abs(unit).sum(axis=1) / np.sqrt(turn.shape[1]), largest


def _packed(bits: np.ndarray) -> np.ndarray:
    packed = np.packbits(bits, axis=1)
    return np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8))).view("<u8")


class Rounded:
    """Rotated queries at ``PLANES`` bits a dimension: low + step * value, the values as bit planes."""

    def __init__(self, rotated: np.ndarray):
        self.dim, self.sum = rotated.shape[1], rotated.sum(axis=1)
        self.low = rotated.min(axis=1)
        self.step = np.maximum((rotated.max(axis=1) - self.low) / ((1 << PLANES) - 1), 1e-300)
        value = np.rint((rotated - self.low[:, None]) / self.step[:, None]).astype(np.uint8)
        self.lost = np.linalg.norm(rotated - self.low[:, None] - self.step[:, None] * value, axis=1)
        self.planes = [_packed(value >> j & 1) for j in range(PLANES)]


def estimate(bits: np.ndarray, norm: np.ndarray, a: np.ndarray, queries: Rounded, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimates of <v, q>, candidates by queries, and their error bounds; ``length`` holds the queries' norms."""
    scale = norm / (a * np.sqrt(queries.dim))
    est = np.empty((len(bits), len(length)), np.float32)
    ones = np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
    for i in range(0, len(bits), step := max(1, _CELLS // max(1, len(length)))):
        part = bits[i : i + step]
        total = np.zeros((len(part), len(length)), np.int32)
        for j, plane in enumerate(queries.planes):
            shared = np.zeros(total.shape, np.int32)
            for w in range(bits.shape[1]):
                shared += np.bitwise_count(part[:, w, None] & plane[:, w])
            total += shared << j
        signed = 2 * (queries.low * ones[i : i + step, None] + queries.step * total) - queries.sum
        est[i : i + step] = signed * scale[i : i + step, None]
    unseen = np.maximum(0, 1 - a * a) / max(1, queries.dim - 1)
    slack = EPSILON * (norm / a)[:, None] * np.sqrt(unseen[:, None] * length**2 + queries.lost**2 / queries.dim) + (norm * 1e-5)[:, None] * length
    return est, slack.astype(np.float32) + np.float32(1e-37)  # what single precision cannot tell from nothing


def exact(left: np.ndarray, right: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Inner products of left[:, i] and right[:, j], summed from the first dimension to the last."""
    out = np.zeros(len(i))
    with np.errstate(over="ignore", invalid="ignore"):
        for d in range(len(left)):
            out += left[d][i] * right[d][j]
    return out


class Search:
    """The k best of each query of one block, over the candidates that were offered so far."""

    def __init__(self, rows: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.k = rows, k
        part, self.largest = scaled(vectors)
        self.rounded = Rounded(part @ rotation(vectors.shape[1]))
        self.columns, self.length = np.ascontiguousarray(vectors.T), np.linalg.norm(part, axis=1)
        self.score = np.full((len(rows), k), -np.inf)
        self.best = np.full((len(rows), k), np.iinfo(np.int64).max)
        self.real = np.zeros((len(rows), k), bool)

    def _bar(self, scale: float) -> np.ndarray:
        """The scores that candidates of a scale have to reach, in the measure of the estimates; of no use where not finite."""
        with np.errstate(over="ignore", invalid="ignore", under="ignore"):
            last = self.score[:, -1] / self.largest / scale
            return np.where(np.isfinite(last), last - 1e-6 * np.abs(last), -np.inf).astype(np.float32)

    def offer(self, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray, code: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]) -> None:
        """Candidates with their rows, vec_ids, vectors and codes.

        Estimates are of vectors over their largest components, times a candidate's share of the largest of all that are offered.
        """
        bits, norm, a, largest = code
        scale = float(largest.max())
        est, slack = estimate(bits, norm * (largest / scale), a, self.rounded, self.length)
        columns = np.ascontiguousarray(vectors.T)
        fit = lambda: ~(est + slack < self._bar(scale))
        own = rows[:, None] == self.ids
        if self.real[:, -1].all():
            self._merge(ids, columns, fit() & ~own)
            return
        # first, a few of the best estimates set the bar
        top = min(2 * self.k, len(ids))
        best = np.argpartition(-np.where(own, -np.inf, est), top - 1, axis=0)[:top]
        pick = np.zeros(est.shape, bool)
        np.put_along_axis(pick, best, True, axis=0)
        self._merge(ids, columns, pick & ~own)
        self._merge(ids, columns, ~pick & ~own & fit())

    def _merge(self, ids: np.ndarray, columns: np.ndarray, pick: np.ndarray) -> None:
        q, c = np.nonzero(pick.T)
        if not len(q):
            return
        score = np.concatenate([exact(self.columns, columns, q[i : i + 65536], c[i : i + 65536]) for i in range(0, len(q), 65536)])
        better = ~(score < self.score[q, -1]) | ~self.real[q, -1]
        q, c, score = q[better], c[better], score[better]
        who = np.unique(q)
        place = np.repeat(who, self.k)
        real = np.r_[np.ones(len(q), bool), self.real[who].ravel()]
        q, score, found = np.r_[q, place], np.r_[score, self.score[who].ravel()], np.r_[ids[c], self.best[who].ravel()]
        odd = np.isnan(score)  # before all numbers, as Spark orders them
        order = np.lexsort((found, np.where(odd, 0.0, -score), ~odd, ~real, q))
        q, score, found, real = q[order], score[order], found[order], real[order]
        rank = np.arange(len(q)) - np.repeat(np.searchsorted(q, who), np.diff(np.r_[np.searchsorted(q, who), len(q)]))
        top = rank < self.k
        at = q[top], rank[top]
        self.score[at], self.best[at], self.real[at] = score[top], found[top], real[top]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.repeat(self.ids, self.real.sum(axis=1)), self.best[self.real], self.score[self.real]


_CODES = "row long, vec_id long, v array<double>, bits binary, norm double, a double, largest double"


def codes(vectors: DataFrame) -> DataFrame:
    """The table of codes: row (a number of its own), vec_id, v, bits, norm and correction of every vector that takes part."""
    v = F.col("embedding").cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long"), v.alias("v"))

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        size = pc.list_value_length(batch.column(2)).to_numpy()
        for dim in np.unique(size).tolist():
            part = batch.filter(pa.array(size == dim))
            bits, norm, a, largest = encode(_matrix(part.column(2), dim), rotation(dim))
            yield pa.record_batch([*part.columns, pa.array([x.tobytes() for x in bits], pa.binary()), pa.array(norm), pa.array(a), pa.array(largest)], names=[x.split()[0] for x in _CODES.split(", ")])

    return common.materialize(common.map_arrow(rows.where(F.col("vec_id").isNotNull() & fine), run, _CODES), "ann-codes")[0]


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _found(candidates: DataFrame, rows: np.ndarray, block: np.ndarray, k: int) -> DataFrame:
    shared, dim = candidates.sparkSession.sparkContext.broadcast((rows, block)), block.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = None
        for batch in batches:
            if batch.num_rows:
                search = search or Search(*shared.value, k)
                row, vec, norm, a, largest = (batch.column(c).to_numpy() for c in (0, 1, 4, 5, 6))
                v, bits = _matrix(batch.column(2), dim), np.frombuffer(b"".join(batch.column(3).to_pylist()), "<u8").reshape(len(row), -1)
                for i in range(0, len(vec), _ROWS):
                    j = i + _ROWS
                    search.offer(row[i:j], vec[i:j], v[i:j], (bits[i:j], norm[i:j], a[i:j], largest[i:j]))
        if search:
            q, c, s = search.rows()
            yield pa.record_batch([pa.array(q), pa.array(c), pa.array(s)], names=["query", "vec_id", "score"])

    return common.in_arrow(candidates.where(F.size("v") == dim), run, "query long, vec_id long, score double")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest of ``vectors`` to each of ``queries`` (rows of one table of codes)."""
    lots_found: list[DataFrame] = []
    dims = [(r[0], r[1]) for r in queries.groupBy(F.size("v").alias("d")).count().orderBy("d").toLocalIterator()]
    for dim, n in dims:
        own = queries.where(F.size("v") == dim).select("row", "v")
        lots = max(1, -(-n * dim * 8 // BLOCK_BYTES))
        for lot in range(lots):
            part = own if lots == 1 else own.where(F.pmod(F.xxhash64("row"), F.lit(lots)) == lot)
            rows = sorted(part.collect())
            if rows:
                numbers, block = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
                lots_found.append(_found(vectors, numbers, block, k))
                if len(lots_found) == UNION:  # many blocks: written so far, so that the plan stays small
                    lots_found = [common.materialize(_ranked(lots_found, k).drop("rank"), "ann-best")[0]]
    if not lots_found:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    best = _ranked(lots_found, k).join(queries.select(F.col("row").alias("query"), F.col("vec_id").alias("query_id")), "query")
    return best.select("query_id", "rank", "vec_id", "score")


def _ranked(found: list[DataFrame], k: int) -> DataFrame:
    """The k best of each query over all tasks' rows."""
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    rows = reduce(DataFrame.unionByName, found)
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def op9_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = codes(common.table(spark, sf_dir, "embeddings"))
    return nearest(vectors, vectors.where("vec_id % 20 = 0"))


#: Exact search; the codes only choose what is reranked, on the same vectors and in the same order of summation.
OP9_SQL = """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v) AS score
      FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM p QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20
"""
