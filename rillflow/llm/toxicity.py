"""Toxicity: a weighted lexicon, learned from labels and matched by Aho-Corasick in folded texts.

Folding takes compatibility forms to plain ones, letters of other scripts that look like Latin ones to these, digits and signs
between letters to the letters they stand for, and all that is no letter or digit to one space. Entries of the lexicon are
beginnings of words and whole words. Each has a weight: the logarithm of its rate in toxic texts over that in others. Exception
phrases, longer stretches around an entry that are commoner in other texts, void it. A text's sum of weights, plain and over
its length, gives the score by a logistic curve.

Learning takes at most about ``SAMPLE`` labelled texts of each label, drawn by a hash of the id; they are scanned three times on
executors: beginnings that enough toxic texts hold, their counts in the others, and the distinct surroundings of those that
stand out, so that copies of one text count once. Only entries that stand out and a number triple a sampled text reach the
driver, which both the sample bounds. Scoring is one scan of the documents, without a shuffle.

Defined cases: a null or empty text, or one without letters and digits, holds no entry and gets the score of such texts; repeated rows are
scored each, and count once a row in the sample; a row without doc_id is scored and is not held out; an id labelled twice has its
largest label, labels other than 0 and 1 count for nothing; without labels every score is 0, with labels of one kind only it is that
kind's smoothed share; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import accumulate, product

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillflow.llm import common

#: Labelled texts of each label that learning takes, about.
SAMPLE = 30_000
#: Letters of an entry that is a beginning, and of a whole word, at most; least letters of a beginning.
SHORTEST, LONGEST = 3, 10
#: An entry has at least so many surroundings in toxic texts, and so many a toxic text of the sample.
SUPPORT, SHARE = 5, 0.004
#: Least ratio of an entry's rate in toxic texts to that in others.
RATIO = 8.0
#: Texts of the other kind that an exception stands in, at least.
EXCEPTIONS = 3

#: Letters that look like Latin ones, and those they look like.
HOMOGLYPHS = str.maketrans(
    {
        "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "ԛ": "q", "ԝ": "w", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h",
        "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɑ": "a", "ɡ": "g",
    }
)
#: What digits and signs stand for; 1 can stand for l as well, which entries allow for.
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i"}

_LETTER = r"[^\W\d_]"
_SWAPPED = re.compile(rf"(?<={_LETTER})[0134578@$!]{{1,2}}(?={_LETTER})|(?<![\w@$!])[0134578@$]{{1,2}}(?={_LETTER}[^\W_])")
_REST = re.compile(r"[\W_]+")


def fold(text: str | None) -> str:
    """Folded words between single spaces, one in front and one behind."""
    text = text or ""
    if not unicodedata.is_normalized("NFKC", text):
        text = unicodedata.normalize("NFKC", text)
    text = text.lower()
    if not text.isascii():
        text = text.translate(HOMOGLYPHS)
    text = _SWAPPED.sub(lambda m: "".join(map(DIGITS.__getitem__, m[0])), text)
    return f" {_REST.sub(' ', text).strip()} "


def _beginnings(word: str) -> list[str]:
    """The entries that a word can be: its beginnings, and itself to the end."""
    out = [" " + word[:k] for k in range(SHORTEST, min(LONGEST, len(word)) + 1)]
    return out + [f" {word} "] if len(word) <= LONGEST else out


@dataclass
class Model:
    """Weights of the entries, exception phrases, and the curve from a text's sum and words to its score."""

    lexicon: dict[str, float] = field(default_factory=dict)
    exceptions: frozenset[str] = frozenset()
    curve: tuple[float, float, float] | None = None
    constant: float = 0.0

    def matcher(self) -> Callable[[str], Iterator[tuple[int, int, float]]]:
        """A function that finds (start, end, weight) of all entries in a folded text: the longest at each word, none that an exception covers."""
        found = ahocorasick.Automaton()
        for entry, weight in self.lexicon.items():
            for form in _forms(entry):
                found.add_word(form, (len(form), weight))
        for phrase in self.exceptions:
            found.add_word(phrase, (len(phrase), 0.0))
        if not self.lexicon:
            return lambda text: iter(())
        found.make_automaton()

        def match(text: str) -> Iterator[tuple[int, int, float]]:
            best: dict[int, tuple[int, float]] = {}
            void = []
            for last, (size, weight) in found.iter(text):
                if weight:
                    best[last - size + 1] = (last + 1, weight)  # matches come by their ends, so the longest of a start is the last
                else:
                    void.append((last - size + 1, last + 1))
            starts = [a for a, _ in sorted(void)]
            ends = list(accumulate((b for _, b in sorted(void)), max))
            for start, (end, weight) in best.items():
                k = bisect_right(starts, start)
                if not k or ends[k - 1] < end:
                    yield start, end, weight

        return match


def _forms(entry: str) -> set[str]:
    """An entry, also with i in the place of l, as 1 is folded."""
    at = [k for k, c in enumerate(entry) if c == "l"][:4]
    out = set()
    for choice in product("li", repeat=len(at)):
        letters = list(entry)
        for k, c in zip(at, choice):
            letters[k] = c
        out.add("".join(letters))
    return out


def _features(total: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.stack([np.log1p(total), np.log1p(100 * total / (words + 10)), np.ones(len(total))], 1)


def _fitted(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float, float]:
    """Logistic regression by Newton's method; a feature whose coefficient would be negative is left out."""
    use = np.ones(x.shape[1], bool)
    while True:
        w = np.zeros(use.sum())
        part = x[:, use]
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(part @ w, -500, 500)))
            slope = part.T @ (weight * (y - p)) - 0.01 * w
            bend = (part * (weight * p * (1 - p))[:, None]).T @ part + 0.01 * np.eye(len(w))
            step = np.linalg.solve(bend, slope)
            step *= min(1.0, 3 / max(np.abs(step).max(), 1e-9))
            w += step
            if np.abs(step).max() < 1e-9:
                break
        out = np.zeros(x.shape[1])
        out[use] = w
        if (out[:-1] >= 0).all():
            return tuple(out.tolist())
        use[:-1] &= out[:-1] > 0


def sample(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> tuple[DataFrame, str, dict[int, float]]:
    """(toxic, text) of the labelled texts to learn from, folded; its path; and which part of each label it is."""
    marked = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    part = {r["toxic"]: min(1.0, size / r["count"]) for r in marked.groupBy("toxic").count().collect()}
    draw = (F.xxhash64("doc_id") % 1_000_003 + 1_000_003) % 1_000_003 / 1_000_003
    bound = F.lit(0.0)
    for label, share in part.items():
        bound = F.when(F.col("toxic") == label, share).otherwise(bound)
    drawn = F.broadcast(marked.where(draw < bound))  # about ``size`` rows of each label
    joined = docs.where("text IS NOT NULL").select(F.col("doc_id").cast("long"), "text").join(drawn, "doc_id").select("toxic", "text")

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        yield pa.record_batch([batch.column(0), pa.array([fold(t.as_py()) for t in batch.column(1)], pa.string())], names=["toxic", "text"])

    out, path = common.materialize(common.map_arrow(joined, run, "toxic int, text string"), "toxicity-sample")
    return out, path, part


def _counts(texts: DataFrame, each: Callable[[list[str]], Counter]) -> DataFrame:
    """(term, n): counts that ``each`` makes of a text's words, summed in a batch before the shuffle."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for text in batch.column(0):
            total.update(each(text.as_py().split()))
        yield pa.record_batch([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], names=["term", "n"])

    return common.map_arrow(texts.select("text"), run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))


def _surroundings(texts: DataFrame, terms: frozenset[str]) -> dict[str, int]:
    """In how many distinct pairs of neighbours each term stands."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        found = set()
        for text in batch.column(0):
            words = text.as_py().split()
            for k, word in enumerate(words):
                for term in _beginnings(word):
                    if term in terms:
                        found.add((term, xxhash.xxh64_intdigest(" ".join(words[max(0, k - 1) : k + 2])) - (1 << 63)))
        yield pa.record_batch([pa.array([t for t, _ in found], pa.string()), pa.array([h for _, h in found], pa.int64())], names=["term", "h"])

    pairs = common.map_arrow(texts.select("text"), run, "term string, h long").distinct()
    return {r["term"]: r["count"] for r in pairs.groupBy("term").count().collect()}


def _chosen(toxic: dict[str, int], other: dict[str, int], words: tuple[int, int], least: float) -> dict[str, float]:
    """The lexicon: the term that tells most, of equal ones the longest, then what is left of the others without it, and so on."""
    a, b = dict(toxic), Counter(other)

    def tells(term: str) -> float:
        return math.log((a[term] + 0.1) / words[0] / ((max(b[term], 0) + 0.5) / words[1]))

    out, left = {}, set(a)
    while True:
        left = {t for t in left if a[t] >= least and tells(t) >= math.log(RATIO)}
        if not left:
            return out
        best = max(left, key=lambda t: (a[t] * tells(t), len(t), t))
        out[best] = tells(best)
        left = {t for t in left if not t.startswith(best.rstrip())}
        for k in range(SHORTEST + 1, len(best)):
            if best[:k] in a:
                a[best[:k]] -= a[best]
                b[best[:k]] -= b[best]


def learn(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> Model:
    """The model of the labelled documents."""
    texts, path, part = sample(docs, labels, size)
    n = {r["toxic"]: (r["rows"], r["words"]) for r in texts.groupBy("toxic").agg(F.count("*").alias("rows"), F.sum(F.size(F.split("text", " ")) - 2).alias("words")).collect()}
    if not n.keys() >= {0, 1}:
        common.discard(texts.sparkSession, path)
        rows = sum(r for r, _ in n.values())
        return Model(constant=(n.get(1, (0, 0))[0] + 0.5) / (rows + 1) if rows else 0.0)
    toxic, other = texts.where("toxic = 1"), texts.where("toxic = 0")
    words = (max(n[1][1], 1), max(n[0][1], 1))
    least = max(SUPPORT, SHARE * n[1][0])
    held = {r["term"]: r["n"] for r in _counts(toxic, lambda w: Counter({t for x in set(w) for t in _beginnings(x)})).where(F.col("n") >= least).collect()}
    known = frozenset(held)
    elsewhere = {r["term"]: r["n"] for r in _counts(other, lambda w: Counter(t for x in w for t in _beginnings(x) if t in known)).collect()}
    apart = frozenset(t for t, k in held.items() if k / words[0] >= elsewhere.get(t, 0) / words[1])
    model = Model(_chosen(_surroundings(toxic, apart), elsewhere, words, least))
    model.exceptions = _exceptions(toxic, other, model, words)
    rows = _measured(texts, model, folded=True).select("toxic", "total", "n_words").toPandas()
    y = rows["toxic"].to_numpy(float)
    model.curve = _fitted(_features(rows["total"].to_numpy(), rows["n_words"].to_numpy()), y, np.where(y > 0, 1 / part[1], 1 / part[0]))
    common.discard(texts.sparkSession, path)
    return model


def _exceptions(toxic: DataFrame, other: DataFrame, model: Model, words: tuple[int, int]) -> frozenset[str]:
    """Words around an entry, alone and with a neighbour, that are commoner in other texts than in toxic ones."""

    def phrases(words: list[str]) -> Counter:
        text = f" {' '.join(words)} "
        out = set()
        for start, end, _ in model.matcher()(text):
            stop = text.index(" ", end - 1) if text[end - 1] != " " else end - 1
            word = text[start : stop + 1]
            before, after = text.rfind(" ", 0, start), text.find(" ", stop + 1)
            out |= {word} if word not in model.lexicon else set()
            out |= {text[before : stop + 1]} if start else set()
            out |= {text[start : after + 1]} if after > 0 else set()
        return Counter(out)

    there = {r["term"]: r["n"] for r in _counts(other, phrases).where(F.col("n") >= EXCEPTIONS).collect()}
    if not there:
        return frozenset()
    here = {r["term"]: r["n"] for r in _counts(toxic, lambda w: Counter({t: n for t, n in phrases(w).items() if t in there})).collect()}
    return frozenset(t for t, n in there.items() if (n + 0.5) / words[1] > (here.get(t, 0) + 0.5) / words[0])


def _measured(texts: DataFrame, model: Model, folded: bool = False) -> DataFrame:
    """All columns of ``texts`` but text, with the sum of weights, the number of words and the entries found."""
    kept = [f for f in texts.schema.fields if f.name != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = model.matcher()
        for batch in batches:
            total, n, terms = [], [], []
            for text in batch.column(batch.schema.get_field_index("text")):
                text = text.as_py() if folded else fold(text.as_py())
                found = sorted(match(text))
                total.append(sum(w for _, _, w in found))
                n.append(text.count(" ") - 1 if len(text) > 2 else 0)
                terms.append([text[a:b].strip() for a, b, _ in found])
            columns = [batch.column(batch.schema.get_field_index(f.name)) for f in kept]
            yield pa.record_batch(
                [*columns, pa.array(total, pa.float64()), pa.array(n, pa.int64()), pa.array(terms, pa.list_(pa.string()))],
                names=[*(f.name for f in kept), "total", "n_words", "terms"],
            )

    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in kept), "total double, n_words long, terms array<string>"])
    return common.in_arrow(texts, run, schema)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, n_words, terms) of every row: its score and the entries behind it."""
    out = _measured(docs.select(F.col("doc_id").cast("long"), "text"), model)
    value = F.lit(model.constant)
    if model.curve is not None:
        by_sum, by_length, least = (F.lit(c) for c in model.curve)
        value = 1 / (1 + F.exp(-(by_sum * F.log1p("total") + by_length * F.log1p(100 * F.col("total") / (F.col("n_words") + 10)) + least)))
    return out.select("doc_id", value.alias("score"), "n_words", "terms")


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    model = learn(docs, labels.where(~held_out))
    return score(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
