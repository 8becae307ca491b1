"""Language identification by nearest centroid.

A text becomes a TF-IDF vector of its letter n-grams (one to three bytes of the lower-case UTF-8 text,
everything that is not a letter read as a space), hashed to ``DIM`` places and scaled to length one.
Each language has up to ``CENTROIDS`` centroids from spherical k-means. A text gets the language of the
centroid of highest cosine. It is rejected if that cosine, over the median cosine of training texts of about its length,
is below a bound: the ``QUANTILE`` lowest such ratio of the training texts, ``RATIO`` at most, so that few texts
do not set a bound that many would not.

Document frequencies, each language's share averaged over the languages, come from all training texts, medians and bound from all of one in ``FOLD`` of them that the centroids
are not fitted on. The centroids are fitted on a bounded sample: at most ``SAMPLE`` labelled whole texts of each language, those of the
smallest hashes of doc_id and text, of about ``TOTAL`` in all, for the ``LANGUAGES`` most frequent languages (ties by
code point); rarer ones are not learned, nor is a language that has texts in the other fold alone.
Prediction reads the text alone.

Defined cases: a null text or one without a letter is ``und`` with score 0 and rejected; rows without
lang or doc_id are not learned from; with nothing to learn from, every row is ``und``; ties go to the
language first by code point; repeated rows are predicted each; extra columns are ignored by the
digest and kept by the filter.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rillflow.llm import common

DIM = 1 << 12
SAMPLE = 600
#: Most texts of the fit, but for ``LEAST`` of each language.
TOTAL = 4000
LEAST = 8
LANGUAGES = 4096
CENTROIDS = 4
#: One in so many training texts sets the bound of rejection.
FOLD = 4
QUANTILE = 0.001
RATIO = 0.3
#: Texts that a centroid must own: this share of its language's, or TIGHT that lie closer to it than those of the largest do.
SHARE = 0.1
TIGHT = 5
LEVELS = 16
_BINS = 1000
_ROUNDS = 12
_LETTER = regex.compile(r"\p{L}")
#: Bytes below 128 that are not letters become spaces.
_CLEAN = bytes(b if b > 127 or chr(b).isalpha() else 32 for b in range(256))
_PIECE = 1 << 20


def counts(text: str) -> np.ndarray:
    """Hashed n-gram counts of a whole text."""
    data = np.frombuffer(b" " + text.lower().encode("utf-8", "surrogatepass").translate(_CLEAN) + b" ", np.uint8)
    out = np.zeros(DIM, np.float32)
    for i in range(0, len(data), _PIECE):  # pieces share two bytes, which start no gram of the earlier piece
        part = data[i : i + _PIECE + 2].astype(np.uint32)
        own = min(_PIECE, len(data) - i)
        two = part[:-1] * np.uint32(257) + part[1:]
        three = two[:-1] * np.uint32(65599) + part[2:] * np.uint32(31)
        for gram, ignore in ((part, 32), (two, 32 * 258), (three, None)):
            gram = gram[:own]
            if ignore is not None:
                gram = gram[gram != ignore]
            out += np.bincount((gram * np.uint32(2654435761)) >> np.uint32(20), minlength=DIM)
    return out


def _level(total: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(total, 1)).astype(int), LEVELS - 1)


class Model:
    """idf, unit centroids with their languages, and the lowest accepted cosine by length."""

    def __init__(self, vectors: np.ndarray, langs: list[str], texts: int, frequency: np.ndarray):
        """From the sample's counts and languages, the number of all training texts, and how many of as many, balanced by language, hold each place."""
        self.langs = sorted(set(langs))
        self.idf = np.log((1 + texts) / (1 + frequency.astype(np.float64))).astype(np.float32) + np.float32(0.1)
        unit, label = self.unit(vectors), np.array([self.langs.index(x) for x in langs], int)
        parts = [self._cluster(unit[label == k]) for k in range(len(self.langs))]
        self.centroids = np.concatenate(parts) if parts else np.zeros((0, DIM), np.float32)
        self.owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        self.floor = np.zeros(LEVELS)

    def calibrate(self, seen: np.ndarray) -> None:
        """Set the bounds from ``seen``: how many training texts of each length reach each cosine, in ``_BINS`` steps."""
        n = seen.sum(axis=1)
        if not n.sum():
            return
        middle = np.array([(np.searchsorted(np.cumsum(row), (k + 1) // 2) + 0.5) / _BINS if k else np.nan for row, k in zip(seen, n)])
        for k in range(1, LEVELS):  # lengths without a text: as the next shorter ones, or scaled down from longer ones
            if np.isnan(middle[k]):
                middle[k] = middle[k - 1]
        for k in range(LEVELS - 2, -1, -1):
            if np.isnan(middle[k]):
                middle[k] = middle[k + 1] / np.sqrt(2)
        ratio = ((np.arange(_BINS) + 0.5) / _BINS / middle[:, None]).ravel()
        order = np.argsort(ratio, kind="stable")
        least = ratio[order][np.searchsorted(np.cumsum(seen.ravel()[order]), QUANTILE * n.sum(), "right")]
        self.floor = min(RATIO, least) * middle

    def unit(self, vectors: np.ndarray) -> np.ndarray:
        v = np.log1p(vectors)
        v *= self.idf
        v /= np.maximum(np.sqrt(np.einsum("ij,ij->i", v, v))[:, None], 1e-12)
        return v

    @staticmethod
    def _cluster(unit: np.ndarray) -> np.ndarray:
        pick, far = [0], np.full(len(unit), -1.0)
        while len(pick) < min(CENTROIDS, len(unit)):  # next, the text farthest from all picked
            far = np.maximum(far, unit @ unit[pick[-1]])
            pick.append(int(far.argmin()))
        centre = unit[pick]
        for _ in range(_ROUNDS):
            near = (unit @ centre.T).argmax(axis=1)
            centre = np.stack([unit[near == k].sum(axis=0) if (near == k).any() else centre[k] for k in range(len(centre))])
            centre /= np.maximum(np.linalg.norm(centre, axis=1, keepdims=True), 1e-12)
        cosine = unit @ centre.T
        near = cosine.argmax(axis=1)
        size = np.bincount(near, minlength=len(centre))
        close = np.bincount(near, cosine.max(axis=1), minlength=len(centre)) / np.maximum(size, 1)
        return centre[(size >= min(size.max(), SHARE * len(unit))) | (size >= TIGHT) & (close >= close[size.argmax()])]

    def predict(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Language number, cosine and acceptance of each row of counts."""
        cosine = self.unit(vectors) @ self.centroids.T
        best = cosine.argmax(axis=1)
        score = np.clip(cosine[np.arange(len(best)), best].astype(float), 0, 1)
        return self.owner[best], score, score >= self.floor[_level(vectors.sum(axis=1))]


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Learn from rows that have text, lang and doc_id: at most ``sample`` of each language."""
    rows = docs.where("doc_id is not null and lang is not null and text is not null").select(F.col("lang").cast("string"), F.col("text").cast("string"), "doc_id")
    rows = rows.withColumn("fold", F.pmod(F.xxhash64(F.lit("fold"), "doc_id", "text"), F.lit(FOLD)))
    rows = rows.withColumn("draw", F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)))
    per = {r[0]: r[1] for r in rows.where("fold > 0").groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()}
    sample = min(sample, max(LEAST, TOTAL // max(1, len(per))))
    share = docs.sparkSession.sparkContext.broadcast({lang: int((1.5 * sample + 20) / n * (1 << 30)) for lang, n in per.items()})

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The sample's counts, and at last in how many of the task's texts of a language each place occurs (-1: in how many texts)."""
        share_, texts, seen, names = share.value, Counter(), {}, ["lang", "draw", "v", "place", "n"]
        kinds = (pa.string(), pa.int64(), pa.binary(), pa.int32(), pa.int64())
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                out: list[tuple] = []
                for lang, text, draw in zip(*(batch.column(c)[i : i + 256].to_pylist() for c in range(3))):
                    if lang in share_ and _LETTER.search(text):
                        v = counts(text)
                        texts[lang] += 1
                        seen.setdefault(lang, np.zeros(DIM, np.int32))[v > 0] += 1
                        if draw < share_[lang]:
                            out.append((lang, draw, v.astype("<f4").tobytes(), None, None))
                if out:
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)
        for lang, held in seen.items():
            places, n = [-1, *np.flatnonzero(held).tolist()], [texts[lang], *held[held > 0].tolist()]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(([lang] * len(n), [None] * len(n), [None] * len(n), places, n), kinds)], names=names)

    drawn, path = common.materialize(common.in_arrow(rows.where("fold > 0").select("lang", "text", "draw"), vectors, "lang string, draw long, v binary, place int, n long"), "langid")
    sums = drawn.where("place is not null").groupBy("lang", "place").agg(F.sum("n").alias("n"))
    sizes = sums.where("place = -1").select("lang", F.col("n").alias("texts"))
    shares = sums.join(sizes, "lang").groupBy("place").agg(F.sum("n").alias("n"), F.sum(F.col("n") / F.col("texts")).alias("share"))
    seen = {r.place: (r.n, r.share) for r in shares.collect()}  # a row for each of DIM places
    first = F.row_number().over(Window.partitionBy("lang").orderBy("draw", "v"))
    got = drawn.where("place is null").withColumn("nth", first).where(F.col("nth") <= sample).select("lang", "v").toArrow().sort_by([("lang", "ascending"), ("v", "ascending")])
    common.discard(docs.sparkSession, path)
    texts, langs = seen.get(-1, (0, 0.0))
    frequency = np.array([round(seen.get(k, (0, 0.0))[1] / max(langs, 1) * texts, 6) for k in range(DIM)])
    model = Model(np.frombuffer(b"".join(x.as_py() for x in got["v"]), "<f4").reshape(-1, DIM), got["lang"].to_pylist(), texts, frequency)
    if model.langs:
        shared = docs.sparkSession.sparkContext.broadcast(model)

        def reached(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = np.zeros((LEVELS, _BINS), np.int64)
            for batch in batches:
                for i in range(0, batch.num_rows, 256):
                    held = [counts(t) for t in batch.column(0)[i : i + 256].to_pylist() if _LETTER.search(t)]
                    if held:
                        _, score, _ = shared.value.predict(v := np.stack(held))
                        np.add.at(table, (_level(v.sum(axis=1)), np.minimum((score * _BINS).astype(int), _BINS - 1)), 1)
            level, step = np.nonzero(table)
            yield pa.record_batch([pa.array(level, pa.int32()), pa.array(step, pa.int32()), pa.array(table[level, step])], names=["level", "step", "n"])

        seen_at = np.zeros((LEVELS, _BINS), np.int64)
        for level, step, n in common.in_arrow(rows.where("fold = 0").select("text"), reached, "level int, step int, n long").groupBy("level", "step").agg(F.sum("n")).collect():
            seen_at[level, step] = n
        model.calibrate(seen_at)
    return model


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with lang_pred, score and rejected; where ``docs`` has such a column, with underscores behind."""
    added = common.fresh(docs, "lang_pred", "score", "rejected")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    spot = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            texts, n = batch.column(spot), batch.num_rows
            lang, score, rejected = ["und"] * n, np.zeros(n), np.ones(n, bool)
            for i in range(0, n, 256):
                at = [k for k in range(i, min(n, i + 256)) if len(m.langs) and (t := texts[k].as_py()) and _LETTER.search(t)]
                if at:
                    which, score[at], ok = m.predict(np.stack([counts(texts[k].as_py()) for k in at]))
                    rejected[at] = ~ok
                    for k, x in zip(at, which):
                        lang[k] = m.langs[x]
            yield pa.record_batch([*batch.columns, pa.array(lang), pa.array(score), pa.array(rejected)], names=[*batch.schema.names, *added])

    return common.in_arrow(docs, run, f"{docs._jdf.schema().toDDL()}, {added[0]} string, {added[1]} double, {added[2]} boolean")


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % 4 == 2


def classify(docs: DataFrame) -> DataFrame:
    """``docs`` with predictions of a model that has not seen the held-out rows."""
    return predict(docs, fit(docs.where(~held_out())))


def keep_known(docs: DataFrame) -> DataFrame:
    """The documents that are not rejected."""
    return classify(docs).where(~F.col(common.fresh(docs, "rejected")[0])).select(*common.own(docs))


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = F.coalesce(held_out(), F.lit(False)).alias("held_out")
    return classify(docs).select("doc_id", out, "lang_pred", "score", "rejected")
