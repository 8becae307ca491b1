"""Line dedup with a log-template tree of fixed depth.

A line's path in the tree is its token count, then its ``LEAD`` leading tokens; the leaf holds
templates, in which variable fields are a wildcard. Tokens with a digit are variable from the start.
Below the leading tokens a line of ``LONG`` or more tokens is also entered under ``PARTS``
generalisations, each with one of equal stretches of its tokens as a wildcard, so lines that differ
within one stretch share a template. A line of ``LONGER`` or more tokens, of which half identify it, is entered with any two of its
stretches as wildcards, the leading tokens counting as a stretch, so lines that differ in several places share one as well.
A template that occurs in ``MIN_DOCS`` or more documents is
recurring; its lines are dropped from all documents but the one of the smallest doc_id, so that
material shared by copies survives once.

The tree is never built in one place: a node is a 64-bit digest of path and template, counted with
a document once, summed per batch before the shuffle. Recurring templates are broadcast if there are
at most ``MOST_KEYS``; beyond that, lines meet them in a join.

Defined cases: null and empty texts are returned as they are; blank lines are kept and never counted;
every row is a document, also with a repeated or null doc_id (a template whose documents all lack
doc_id keeps all its lines); repeated lines within a document count once, and all go or stay; an empty table
gives an empty result; extra columns are kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillflow.llm import common

LEAD = 2
LONG = 8
LONGER = 16
PARTS = 4
MIN_DOCS = 10
MOST_KEYS = 500_000
_DIGIT = re.compile(rb"[0-9]")
_FIELD = b"<*>"
#: Sets of stretches that are wildcards (0: the leading tokens, then the parts): those of every line, of long and of longer ones.
_WILD = [(), *((k,) for k in range(1, PARTS + 1)), (0,), *combinations(range(PARTS + 1), 2)]
_rng = np.random.default_rng(3)
_ODD = _rng.integers(0, 1 << 63, (len(_WILD), PARTS + 3), np.uint64) * np.uint64(2) + np.uint64(1)
for _c, _w in enumerate(_WILD):
    _ODD[_c, list(_w)] = 0
_R, _S, _T = np.uint64(31), np.uint64(0x9E3779B97F4A7C15), np.uint64(29)


def _digests(line: str) -> tuple[int, ...] | None:
    """Token count, and digests of the leading tokens and of each stretch behind them; none for a blank line."""
    data = line.encode("utf-8", "surrogatepass")
    tokens = data.split()
    n = len(tokens)
    if not n:
        return None
    if _DIGIT.search(data):
        tokens = [_FIELD if _DIGIT.search(t) else t for t in tokens]
    digest, rest = xxhash.xxh64_intdigest, tokens[LEAD:]
    if n < LONG:
        return (digest(b" ".join(tokens[:LEAD])), digest(b" ".join(rest)), *[0] * (PARTS - 1), n)
    m = len(rest)
    return (digest(b" ".join(tokens[:LEAD])), *(digest(b" ".join(rest[m * k // PARTS : m * (k + 1) // PARTS])) for k in range(PARTS)), n)


def _nodes(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Number of the line and digest of every tree node that lines reach, line by line."""
    held = [(k, d) for k, line in enumerate(lines) if (d := _digests(line))]
    if not held:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    at = np.array([k for k, _ in held])
    parts = np.array([d for _, d in held], np.uint64)
    n = parts[:, PARTS + 1]
    reach = np.where(n < LONG, 1, np.where(n < LONGER, 1 + PARTS, len(_WILD)))
    nodes = np.empty((len(held), len(_WILD)), np.uint64)
    for c in range(len(_WILD)):
        x = parts @ _ODD[c, : PARTS + 2] + _ODD[c, PARTS + 2]
        x = (x ^ (x >> _R)) * _S
        nodes[:, c] = x ^ (x >> _T)
    ok = np.arange(len(_WILD)) < reach[:, None]
    return np.repeat(at, reach), nodes[ok].view(np.int64)


def templates(line: str) -> list[int]:
    """Digests of the tree nodes that a line reaches; none for a blank line."""
    return _nodes([line])[1].tolist()


def recurring(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """key, docs and first (smallest doc_id) of the templates of at least ``min_docs`` documents."""
    none = np.iinfo(np.int64).max

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids = [none if d is None else d for d in batch.column(0).to_pylist()]
        owner, lines = [], []
        for k, text in enumerate(batch.column(1)):
            if text := text.as_py():
                own = set(text.split("\n"))
                lines += own
                owner += [k] * len(own)
        at, key = _nodes(lines)
        if len(at):
            doc = np.array(owner)[at]
            order = np.lexsort((doc, key))
            key, doc = key[order], doc[order]
            fresh = np.r_[True, (np.diff(key) != 0) | (np.diff(doc) != 0)]  # a document counts once
            key, first = key[fresh], np.array(ids, np.int64)[doc[fresh]]
            start = np.flatnonzero(np.r_[True, np.diff(key) != 0])
            least = np.minimum.reduceat(first, start)
            yield pa.record_batch([pa.array(key[start]), pa.array(np.diff(np.r_[start, len(key)])), pa.array(least, mask=least == none)], names=["key", "docs", "first"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    each = common.map_arrow(rows, run, "key long, docs long, first long")
    return each.groupBy("key").agg(F.sum("docs").alias("docs"), F.min("first").alias("first")).where(F.col("docs") >= min_docs)


def _rewritten(batch: pa.RecordBatch, spot: int, gone: list, names: list[str], added: tuple[str, str] = ("n_lines", "n_dropped")) -> pa.RecordBatch:
    """The batch with the lines flagged in ``gone`` (by row: a set of line numbers) taken out."""
    texts, n_lines, n_dropped = [], [], []
    for text, drop in zip(batch.column(spot), gone):
        text = text.as_py()
        parts = text.split("\n") if text else []
        n_lines.append(sum(1 for x in parts if x.strip(" \t\n\v\f\r")))
        n_dropped.append(len(drop))
        texts.append("\n".join(x for k, x in enumerate(parts) if k not in drop) if drop else text)
    cols = list(batch.columns[: len(names)])
    cols[spot] = pa.array(texts, pa.string())
    return pa.record_batch([*cols, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], names=[*names, *added])


def drop_lines(docs: DataFrame, min_docs: int = MIN_DOCS, most_keys: int = MOST_KEYS) -> DataFrame:
    """``docs`` with recurring lines out of text, and n_lines and n_dropped (where ``docs`` has such a column, with underscores behind)."""
    hot, _ = common.materialize(recurring(docs, min_docs), "lines-hot")
    names, spot, id_spot = docs.columns, docs.columns.index("text"), docs.columns.index("doc_id")
    n_lines, n_dropped, key, lost_lines = common.fresh(docs, "n_lines", "n_dropped", "_d", "_gone")
    schema = f"{docs._jdf.schema().toDDL()}, {n_lines} long, {n_dropped} long"
    if hot.count() <= most_keys:
        got = hot.where("first is not null").select("key", "first").orderBy("key").toArrow()
        shared = docs.sparkSession.sparkContext.broadcast((got["key"].to_numpy(), got["first"].to_numpy()))

        def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            keys, first = shared.value
            owner, number, lines = [], [], []
            for k, text in enumerate(batch.column(spot)):
                if len(keys) and (text := text.as_py()):
                    own = text.split("\n")
                    owner += [k] * len(own)
                    number += range(len(own))
                    lines += own
            gone: list[set[int]] = [set() for _ in range(batch.num_rows)]
            at, key = _nodes(lines)
            if len(at):
                found = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                hit = np.flatnonzero(keys[found] == key)
                ids = batch.column(id_spot).to_pylist()
                for x, f in set(zip(at[hit].tolist(), first[found[hit]].tolist())):
                    if ids[owner[x]] != f:
                        gone[owner[x]].add(number[x])
            yield _rewritten(batch, spot, gone, names, (n_lines, n_dropped))

        return common.map_arrow(docs, run, schema)

    def reached(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for doc, text, h in zip(*batch.columns):
            if text := text.as_py():
                at, key = _nodes(text.split("\n"))
                if len(at):
                    yield pa.record_batch([pa.array([h.as_py()] * len(at), pa.int64()), pa.array([doc.as_py()] * len(at), pa.int64()), pa.array(at), pa.array(key)], names=["_h", "_doc", "_line", "key"])

    digest = F.xxhash64("doc_id", "text")
    nodes = common.map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), digest.alias("h")), reached, "_h long, _doc long, _line long, key long")
    lost = nodes.join(hot.where("first is not null"), "key").where(~F.col("_doc").eqNullSafe(F.col("first"))).select("_h", "_line").distinct()
    gone = lost.groupBy("_h").agg(F.collect_list("_line").alias(lost_lines)).withColumnRenamed("_h", key)
    joined = docs.withColumn(key, digest).join(gone, key, "left").select(*common.own(docs), lost_lines)

    def apply(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        yield _rewritten(batch, spot, [set(g or ()) for g in batch.column(len(names)).to_pylist()], names, (n_lines, n_dropped))

    return common.map_arrow(joined, apply, schema)


def clean(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """The documents less their recurring lines, n_chars (if there) to match; those of which nothing is left go."""
    n_lines, n_dropped = map(F.col, common.fresh(docs, "n_lines", "n_dropped"))
    kept = drop_lines(docs, min_docs).where((n_lines > n_dropped) | (n_dropped == 0))
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.when(n_dropped > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return kept.select(*common.own(docs))


def op7_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return drop_lines(docs).select("doc_id", "n_lines", "n_dropped", "text")


_STRETCHES = ["lead", *(f"array_to_string(rest[len(rest) * {k} // {PARTS} + 1:len(rest) * {k + 1} // {PARTS}], ' ')" for k in range(PARTS))]
_KEYS = [f"concat_ws(chr(10), {c}, " + ", ".join("''" if k in wild else x for k, x in enumerate(_STRETCHES)) + ")" for c, wild in enumerate(_WILD)]
OP7_SQL = rf"""
WITH l AS (SELECT doc_id, text, line, row_number() OVER () AS id, n FROM (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS n FROM documents)),
t AS (SELECT *, list_transform(regexp_extract_all(line, '[^\x20\x09-\x0D]+'), lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END) AS w FROM l),
r AS (SELECT *, len(w) AS m, array_to_string(w[:{LEAD}], ' ') AS lead, w[{LEAD + 1}:] AS rest FROM t WHERE len(w) > 0),
k AS (SELECT doc_id, id, m, unnest(CASE WHEN m >= {LONGER} THEN [{", ".join(_KEYS)}] WHEN m >= {LONG} THEN [{", ".join(_KEYS[: PARTS + 1])}] ELSE [{_KEYS[0]}] END) AS key FROM r),
h AS (SELECT m, key, min(doc_id) AS first FROM k GROUP BY 1, 2 HAVING count(DISTINCT doc_id) >= {MIN_DOCS}),
g AS (SELECT DISTINCT id FROM k JOIN h USING (m, key) WHERE doc_id <> first)
SELECT d.doc_id, CAST(coalesce(c.n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(c.n_dropped, 0) AS BIGINT) AS n_dropped, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(c.kept, '') END AS text
FROM documents d LEFT JOIN (SELECT doc_id, count(*) FILTER (WHERE len(w) > 0) AS n_lines, count(*) FILTER (WHERE g.id IS NOT NULL) AS n_dropped,
  string_agg(line, chr(10) ORDER BY n) FILTER (WHERE g.id IS NULL) AS kept FROM t LEFT JOIN g ON g.id = t.id GROUP BY 1) c ON c.doc_id = d.doc_id
"""
