"""Periodic runs of words: the maximal repetitions of a text, found on its suffix tree, and the text without their repeats.

A text's words become numbers, and its suffix tree the suffix array with the intervals of equal common prefixes (each
interval is an inner node, its suffixes the node's leaf list). At a node of depth D every leaf outside the largest child is
tested (the smaller halves, Stoye and Gusfield 2002): if the suffix D words further, or D words before, is in the leaf list
too and the next words differ, a *branching tandem repeat* of period D ends there. A run has just one branching repeat of
each of its periods, its last; rotated to the left as far as words D apart are equal, the repeat becomes the maximal run, and
repeats of one stretch merge into the one of the smallest period.

Nodes that no run of the wanted exponent can touch are passed over, which loses nothing: a run of exponent e has e leaves
below its node, and two stretches of four words at least are equal in any text with a run.

Texts are independent, so Spark deals them out and nothing is shuffled. A text of n words takes O(n log n) time and 8 n log n
bytes, in one task; a batch is dropped before the next one comes.

Defined cases: a null or empty text, or one of white space, has no words, no runs and an empty collapsed text; repeated rows
give repeated results; rows with a null doc_id are kept (the query does not rewrite them); an empty table gives an empty
result; extra columns are ignored; ties of the greatest exponent go to the smallest start, then the smallest period.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rillflow.llm import common

#: A run has at least so many words, and so many times its period.
LEAST, TIMES = 6, 4

Run = tuple[int, int, int]


def _ranks(words: np.ndarray) -> list[np.ndarray]:
    """Ranks of all suffixes by their first 1, 2, 4, ... words until all differ; empty if no four words recur."""
    n, h = len(words), 1
    levels = [np.unique(words, return_inverse=True)[1].astype(np.int32)]
    top = int(levels[0].max()) + 1
    while top < n:
        last = levels[-1].astype(np.int64)
        key = last * (n + 1)
        key[: n - h] += last[h:] + 1
        values, inverse = np.unique(key, return_inverse=True)
        top, h = len(values), 2 * h
        levels.append(inverse.astype(np.int32))
    return levels if len(levels) > 3 else []


def _tree(levels: list[np.ndarray]) -> tuple[np.ndarray, list[int]]:
    """Suffix array, and the words that each suffix has in common with the next in order."""
    rank = levels[-1]
    n = len(rank)
    order = np.empty(n, np.int32)
    order[rank] = np.arange(n, dtype=np.int32)
    a, b = order[:-1].astype(np.int64), order[1:].astype(np.int64)
    common_words = np.zeros(n - 1, np.int64)
    for k in range(len(levels) - 2, -1, -1):
        level = np.append(levels[k], np.int32(-1))
        same = level[a] == level[b]
        step = same.astype(np.int64) << k
        common_words += step
        a += step
        b += step
    return order, common_words.tolist()


def _smaller_halves(lcp: list[int], least: int) -> list[tuple[int, int, int, int, int]]:
    """(from, to, depth, first, last) of the leaves outside the largest child of each node with ``least`` leaves or more; positions in the suffix array, ends inclusive."""
    out, stack = [], []
    for i, depth in enumerate([*lcp, 0]):
        left = i
        while stack and stack[-1][0] > depth:
            own, left, cuts = stack.pop()
            if i - left + 1 >= least:
                at, most, large = left, 0, (left, left)
                for cut in [*cuts, i]:
                    if cut - at + 1 > most:
                        most, large = cut - at + 1, (at, cut)
                    at = cut + 1
                if large[0] > left:
                    out.append((left, large[0] - 1, own, left, i))
                if large[1] < i:
                    out.append((large[1] + 1, i, own, left, i))
        if depth:
            if stack and stack[-1][0] == depth:
                stack[-1][2].append(i)
            else:
                stack.append((depth, left, [i]))
    return out


def _branching(words: np.ndarray, rank: np.ndarray, order: np.ndarray, halves: list[tuple[int, int, int, int, int]]) -> np.ndarray:
    """(end, period) of all branching tandem repeats, sorted, without repetition."""
    n = len(words)
    start, stop, depth, first, last = np.array(halves, np.int64).reshape(-1, 5).T
    sizes = stop - start + 1
    which = np.repeat(np.arange(len(sizes)), sizes)
    leaf = order[np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + start[which]].astype(np.int64)
    depth, first, last = depth[which], first[which], last[which]
    ended = np.append(words, -1)
    found = []
    for begin in (leaf, leaf - depth):  # the leaf as the repeat's first half, and as its second
        second, end = begin + depth, begin + 2 * depth
        ok = (begin >= 0) & (second < n)
        one, two = rank[begin[ok]], rank[second[ok]]
        ok[ok] = (one >= first[ok]) & (one <= last[ok]) & (two >= first[ok]) & (two <= last[ok])
        ok[ok] = ended[np.minimum(end[ok], n)] != ended[second[ok]]
        found.append(np.stack([end[ok], depth[ok]], 1))
    return np.unique(np.concatenate(found), axis=0)


def _rotated(words: np.ndarray, begin: int, period: int) -> int:
    """How far to the left a repeat that begins here can be rotated."""
    step = 16
    while begin:
        low = max(0, begin - step)
        differ = np.flatnonzero(words[low:begin] != words[low + period : begin + period])
        if len(differ):
            return low + int(differ[-1]) + 1
        begin, step = low, 2 * step
    return 0


def runs_of(words: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[Run]:
    """(start, length, period) of every maximal run of at least ``least`` words and ``times`` periods, by start and period.

    ``least`` of 5 at least and ``times`` of 3 at least: the bounds that let texts and nodes be passed over.
    """
    if least < 5 or times < 3:
        raise ValueError("runs of at least five words and three periods are found")
    if len(words) < least or not (levels := _ranks(words)):
        return []
    order, lcp = _tree(levels)
    if max(lcp) < 4:
        return []
    halves = _smaller_halves(lcp, times)
    if not halves:
        return []
    found: dict[tuple[int, int], int] = {}
    at, here = -1, []  # runs that end at this place: start, period
    for end, period in _branching(words, levels[-1], order, halves).tolist():
        if end != at:
            at, here = end, []
        begin, need = end - 2 * period, max(least, times * period)
        if need > end or any(period % q == 0 and begin >= s for s, q in here):
            continue
        if begin > end - need and words[begin - 1] != words[begin - 1 + period]:
            continue
        start = _rotated(words, begin, period)
        here.append((start, period))
        if end - start >= need:
            found.setdefault((start, end), period)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def numbered(words: list[bytes]) -> np.ndarray:
    """Equal words have equal numbers."""
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int32, len(words))


def _kept(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words that no run holds after its first period."""
    gone = np.zeros(len(words) + 1, np.int32)
    for start, length, period in runs:
        gone[start + period] += 1
        gone[start + length] -= 1
    return [words[k] for k in np.flatnonzero(np.cumsum(gone[:-1]) == 0)]


def find(docs: DataFrame, least: int = LEAST, times: int = TIMES, rewrite: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of every row: its runs by start and period, and its words, one space between, without what repeats.

    ``rewrite`` makes the words to be looked at out of a row's own ones.
    """
    drawn = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        sizes, spans, texts = [], [], []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary())):
            words = (text.as_py() or b"").split()
            if rewrite:
                words = rewrite(doc, words)
            found = runs_of(numbered(words), least, times)
            sizes.append(len(words))
            spans.append([dict(zip(("start", "length", "period"), r)) for r in found])
            texts.append(b" ".join(_kept(words, found) if found else words))
        texts = pa.array(texts, pa.large_binary()).cast(pa.large_string()).cast(pa.string())
        yield pa.record_batch([batch.column(0), pa.array(sizes, pa.int64()), pa.array(spans, drawn), texts], names=["doc_id", "n_words", "runs", "collapsed"])

    schema = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    return common.map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, schema)


def planted(doc: int | None, words: list[bytes]) -> list[bytes]:
    """The contract's rewriting: one text of ten repeats a stretch of its own to its end."""
    h = 1 if doc is None else zlib.crc32(str(doc).encode())
    if h % 10 or not words:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + k % p] for k in range(n - a)] if a + p <= n else words


def _best() -> Column:
    """The run of the greatest length over period; of equal ones the first."""
    return F.aggregate("runs", F.expr("CAST(NULL AS struct<start:bigint,length:bigint,period:bigint>)"), lambda a, r: F.when(a.isNull() | (r["length"] * a["period"] > a["length"] * r["period"]), r).otherwise(a))


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(common.table(spark, sf_dir, "documents"), rewrite=planted).withColumn("best", _best())
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period"))), F.lit("\n"))), "")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
