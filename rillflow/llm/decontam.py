"""Benchmark decontamination by a broadcast set of normalised test n-grams.

Windows of ``WINDOW`` consecutive words of every benchmark item (an item of fewer words is one window)
form a hash set that is broadcast: sorted hashes, the place of each window in one buffer of text, and its items, some
50 bytes a window with the text. Documents are scanned with rolling window hashes; what the set
finds is compared byte for byte with the buffer, and the words inside are marked. Items are broadcast in slices of at
most ``SLICE`` bytes of UTF-8 text (or one item); with more than one slice, each is scanned for on its own, only what it
hits is written, by the hash of the text, and the hits meet the documents in one join: no benchmark is too large, none is cut short,
and the corpus is never rewritten for a slice.

Defined cases: a null or empty text has no words and no hits; items of no words never occur; rows of
the benchmark without item_id are ignored; repeated item_ids count once; repeated documents are
scanned each; an empty benchmark leaves every document clean; extra columns are ignored by the digest
and kept by the removers.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rillflow.llm import common, tokens

WINDOW = 10
SLICE = 8 << 20


class _Set(NamedTuple):
    """Windows of one length: sorted hashes, a bitmap of their leading bits, each one's first word, and where its items start."""

    keys: np.ndarray
    map: np.ndarray
    shift: np.uint64
    first: np.ndarray
    at: np.ndarray
    items: np.ndarray
    odd: dict[int, list[tuple[int, list[int]]]]  # other windows of the same hash


class Index:
    """Windows of some items, in arrays."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        self.names = [item for item, _ in items]
        data = [text.encode("utf-8", "surrogatepass") for _, text in items]
        offsets = np.r_[0, np.cumsum([len(x) for x in data])].astype(np.int64)
        w = tokens.Words(np.frombuffer(b"".join(data), np.uint8), offsets)
        self.buf, self.start, self.end = w.buf, w.start.astype(np.int32), w.end.astype(np.int32)
        size = np.minimum(window, np.bincount(w.doc, minlength=len(items)))
        self.sets = {int(n): self._set(w, n, size == n) for n in np.unique(size[size > 0])}

    def _set(self, w: tokens.Words, n: int, own: np.ndarray) -> _Set:
        h, whole = w.windows(n)
        at = np.flatnonzero(whole & own[w.doc[: len(h)]])
        at = at[np.argsort(h[at], kind="stable")]
        keys, start = np.unique(h[at], return_index=True)
        odd: dict[int, dict[bytes, tuple[int, set[int]]]] = defaultdict(dict)
        same = np.ones(len(at), bool)
        ends = np.r_[start[1:], len(at)]
        for g in np.flatnonzero(ends - start > 1):
            first = self.text(at[start[g]], n)
            for k in range(start[g] + 1, ends[g]):
                if (text := self.text(at[k], n)) != first:
                    same[k] = False
                    odd[int(h[at[k]])].setdefault(text, (int(at[k]), set()))[1].add(int(w.doc[at[k]]))
        group = np.repeat(np.arange(len(keys)), np.diff(np.r_[start, len(at)]))[same]
        pairs = np.unique(group * np.int64(len(self.names)) + w.doc[at[same]])
        bits = min(26, max(10, int(len(keys) * 8).bit_length()))
        shift = np.uint64(64 - bits)
        seen = np.zeros(1 << bits, bool)
        seen[keys >> shift] = True
        places = np.searchsorted(pairs // len(self.names), np.arange(len(keys) + 1))
        return _Set(keys, seen, shift, at[start].astype(np.int32), places.astype(np.int32), (pairs % len(self.names)).astype(np.int32), {k: [(p, sorted(d)) for p, d in x.values()] for k, x in odd.items()})

    def text(self, word: int, n: int) -> bytes:
        return b" ".join(self.buf[a:b].tobytes() for a, b in zip(self.start[word : word + n], self.end[word : word + n]))

    def hits(self, w: tokens.Words) -> Iterator[tuple[int, int, set[str]]]:
        """(first word, words, items) of each verified window."""
        for n, held in self.sets.items():
            h, whole = w.windows(n)
            at = np.flatnonzero(held.map[h >> held.shift] & whole)
            found = np.searchsorted(held.keys, h[at])
            ok = held.keys[np.minimum(found, len(held.keys) - 1)] == h[at]
            for i, k in zip(at[ok].tolist(), found[ok].tolist()):
                text = w.text(i, n)
                if text == self.text(held.first[k], n):
                    yield i, n, {self.names[x] for x in held.items[held.at[k] : held.at[k + 1]].tolist()}
                for other, docs in held.odd.get(int(held.keys[k]), ()):
                    if text == self.text(other, n):
                        yield i, n, {self.names[x] for x in docs}


def slices(benchmark: DataFrame, most: int = SLICE) -> Iterator[list[tuple[str, str]]]:
    """The items in runs of at most ``most`` bytes (or one item), read one partition at a time."""
    rows = benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string")).where("item_id is not null and text is not null")
    total = rows.agg(F.sum(F.octet_length("text") + F.octet_length("item_id") + 16)).first()[0] or 0
    lots, lot, held = (rows.collect() if total <= most else rows.toLocalIterator()), [], 0
    for item, text in lots:
        size = len(text.encode("utf-8", "surrogatepass")) + len(item.encode("utf-8", "surrogatepass")) + 16
        if lot and held + size > most:
            yield lot
            lot, held = [], 0
        lot.append((item, text))
        held += size
    yield lot


def _found(texts: pa.Array, index: Index | None) -> tuple[list[int], list[list[int]], list[list[str]]]:
    """n_words, hit words (first and past-the-last of each run, flat) and items (sorted) of each text."""
    n_words, spans, items = [], [[] for _ in texts], [set() for _ in texts]
    for i, j, buf, offsets in tokens.chunks(texts.cast(pa.large_string())):
        w = tokens.Words(buf, offsets)
        first = np.searchsorted(w.doc, np.arange(j - i + 1))
        n_words += np.diff(first).tolist()
        for word, n, found in index.hits(w) if index else ():
            row = int(w.doc[word])
            own, at = spans[i + row], word - int(first[row])
            if own and own[-2] <= at <= own[-1]:
                own[-1] = max(own[-1], at + n)
            else:
                own += [at, at + n]
            items[i + row] |= found
    return n_words, [_union(s) for s in spans], [sorted(x) for x in items]


def found_in(docs: DataFrame) -> list[str]:
    """Names of the columns that ``scan`` adds."""
    return common.fresh(docs, "n_words", "hit_words", "items")


_HIT = "array<struct<hit_words:array<long>,items:array<string>>>"


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, most: int = SLICE) -> DataFrame:
    """``docs`` with n_words, hit_words (first and past-the-last word of each hit run, flat) and items (sorted);
    where ``docs`` has such a column, with underscores behind."""
    sc = docs.sparkSession.sparkContext
    added = found_in(docs)
    schema = f"{docs._jdf.schema().toDDL()}, {added[0]} long, {added[1]} array<long>, {added[2]} array<string>"
    kinds = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string()))
    lots = slices(benchmark, most)
    lot, more = next(lots), next(lots, None)
    if more is None:
        shared = sc.broadcast(Index(lot, window))

        def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            made = _found(batch.column(batch.schema.get_field_index("text")), shared.value)
            yield pa.record_batch([*batch.columns, *map(pa.array, made, kinds)], names=[*batch.schema.names, *added])

        return common.map_arrow(docs, run, schema)

    hits = []
    for lot in chain((lot, more), lots):
        hits.append(_hit(docs, sc.broadcast(Index(lot, window))))
        if len(hits) == _UNION:
            hits = [_joined(hits)]
    ((one, two), hit) = common.fresh(docs, "_one", "_two"), common.fresh(docs, "_hit")[0]
    met = _joined(hits).select(F.col("one").alias(one), F.col("two").alias(two), F.col("hit").alias(hit))
    marked = docs.withColumn(one, _key()[0]).withColumn(two, _key()[1]).join(met, [one, two], "left").select(*common.own(docs), hit)

    def merge(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        made = _found(batch.column(batch.schema.get_field_index("text")), None)
        held = [h or () for h in batch.column(batch.num_columns - 1).to_pylist()]
        spans = [_union([x for h in own for x in h["hit_words"]]) for own in held]
        items = [sorted({x for h in own for x in h["items"]}) for own in held]
        yield pa.record_batch([*batch.columns[:-1], *map(pa.array, (made[0], spans, items), kinds)], names=[*batch.schema.names[:-1], *added])

    return common.map_arrow(marked, merge, schema)


#: Slices whose hits one plan joins.
_UNION = 16


def _key() -> tuple[Column, Column]:
    """Two hashes of a text, of 64 and 32 bits."""
    text = F.col("text").cast("string")
    return F.xxhash64(text, F.length(text)), F.hash(text)


def _hit(docs: DataFrame, shared: Broadcast) -> DataFrame:
    """one and two (the key of a text) and hit of every text that the broadcast slice hits, written."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        _, spans, items = _found(batch.column(2), shared.value)
        at = [k for k, s in enumerate(spans) if s]
        held = pa.array([[{"hit_words": spans[k], "items": items[k]}] for k in at], pa.list_(pa.struct([("hit_words", pa.list_(pa.int64())), ("items", pa.list_(pa.string()))])))
        yield pa.record_batch([batch.column(0).take(pa.array(at, pa.int64())), batch.column(1).take(pa.array(at, pa.int64())), held], names=["one", "two", "hit"])

    one, two = _key()
    rows = docs.select(one.alias("one"), two.alias("two"), F.col("text").cast("string").alias("text"))
    return common.materialize(common.map_arrow(rows, run, f"one long, two int, hit {_HIT}").dropDuplicates(["one", "two"]), "decontam-hits")[0]


def _joined(hits: list[DataFrame]) -> DataFrame:
    every = reduce(DataFrame.unionByName, hits).groupBy("one", "two").agg(F.flatten(F.collect_list("hit")).alias("hit"))
    return common.materialize(every, "decontam-hits")[0]


def _union(flat: list[int]) -> list[int]:
    """Sorted, merged runs."""
    if len(flat) <= 2:
        return flat
    out: list[int] = []
    for a, b in sorted(zip(flat[::2], flat[1::2])):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def remove_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return scan(docs, benchmark).where(F.size(found_in(docs)[1]) == 0).select(*common.own(docs))


def remove_spans(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` whose texts have lost the hit words, with what stands between words of one run."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        spot, texts = batch.schema.get_field_index("text"), []
        for text, flat in zip(batch.column(spot).to_pylist(), batch.column(batch.num_columns - 2).to_pylist()):
            if flat:
                w, data = tokens.words_of(text), text.encode("utf-8", "surrogatepass")
                cuts = [0, *(int(w.start[x]) if k % 2 == 0 else int(w.end[x - 1]) for k, x in enumerate(flat)), len(data)]
                text = b"".join(data[a:b] for a, b in zip(cuts[::2], cuts[1::2])).decode("utf-8", "surrogatepass")
            texts.append(text)
        cols = list(batch.columns[:-3])
        cols[spot] = pa.array(texts, pa.string())
        yield pa.record_batch(cols, names=batch.schema.names[:-3])

    return common.map_arrow(scan(docs, benchmark), run, docs._jdf.schema().toDDL())


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    found = scan(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), benchmark)
    n_hit = F.aggregate("hit_words", F.lit(0).cast("long"), lambda a, x: x - a)  # ends less starts: alternate signs cancel
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("hit_words") > 0).alias("contaminated"),
    )


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP6_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
s AS (SELECT item_id, w, least({WINDOW}, len(w)) AS n FROM b WHERE len(w) > 0),
k AS (SELECT DISTINCT item_id, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS t FROM s),
p AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS t FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM s) WHERE len(w) >= n)),
h AS (SELECT doc_id, i, p.n, item_id FROM p JOIN k ON k.n = p.n AND k.t = p.t),
x AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM h) GROUP BY 1),
y AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM h) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN x ON x.doc_id = d.doc_id LEFT JOIN y ON y.doc_id = d.doc_id
"""
