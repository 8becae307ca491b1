import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from rillflow.llm import toxicity as T

DOCS, LABELS = "doc_id long, text string", "doc_id long, quality int, toxic int"
CALM = "the river runs past old mills and slow green fields where people walk in spring and autumn light".split()


def made(n, seed=1, bad=("gruntle", "snarfy", "zounds")):
    """Calm texts, one of five with words of a bad stem, and as many with an ending that makes one harmless."""
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(CALM) for _ in range(rng.randrange(8, 60))]
        toxic = i % 5 == 0
        for _ in range(1 + len(words) // 20):
            word = rng.choice(bad) + rng.choice(["", "s", "ling"]) if toxic else "zoundsight" if i % 7 == 0 else "fields"
            words.insert(rng.randrange(len(words)), word)
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_fold():
    assert T.fold("Idiоt, 1D10T! ｉｄｉｏｔ id1ot") == " idiot idiot idiot idiot "  # a Cyrillic o in the first
    assert T.fold("room 101, 3rd of 50; tr@sh $tupid") == " room 101 erd of 50 trash stupid "
    assert T.fold(None) == T.fold(" \n.") == "  "
    assert T.fold("Çé_ß") == " çé ß "


def brute_hits(text, lexicon, exceptions):
    """Weights at each word of a folded text: its longest entry, unless an exception around it."""
    out = []
    for m in re.finditer(" (?=[^ ])", text):
        best = max((e for e in lexicon if any(text.startswith(f, m.start()) for f in {e, e.replace("l", "i")})), key=len, default=None)
        if best is None:
            continue
        end = m.start() + len(best)
        if not any(x.start() <= m.start() and end <= x.end() for p in exceptions for x in re.finditer(f"(?={re.escape(p)})", text) for x in [re.compile(re.escape(p)).match(text, x.start())]):
            out.append(lexicon[best])
    return out


def test_matches_equal_a_plain_search():
    rng = random.Random(4)
    words = ["clown", "clo", "clowning", "c1own", "trash", "can", "white", "tra", "idiot", "idiots"]
    model = T.Model({" clown ": 3.0, " clo": 1.0, " tra": 2.0, " trash ": 2.5, " idiot": 4.0}, frozenset([" white trash ", " clowning ", " trash can "]))
    match = model.matcher()
    for _ in range(500):
        text = T.fold(" ".join(rng.choice(words) for _ in range(rng.randrange(12))))
        assert sorted(w for _, _, w in match(text)) == sorted(brute_hits(text, model.lexicon, model.exceptions)), text


def brute_counts(rows, labels):
    toxic, other = ([T.fold(t).split() for i, t in rows if dict((d, x) for d, _, x in labels).get(i) == k] for k in (1, 0))
    sets = Counter(e for ws in toxic for e in {b for w in ws for b in T._beginnings(w)})
    plain = Counter(e for ws in other for w in ws for e in T._beginnings(w))
    around = {}
    for ws in toxic:
        for k, w in enumerate(ws):
            for e in T._beginnings(w):
                around.setdefault(e, set()).add(tuple(ws[max(0, k - 1) : k + 2]))
    return toxic, other, sets, plain, around


def test_learning_equals_plain_counts(spark):
    rows, labels = made(400)
    docs, marks = spark.createDataFrame(rows, DOCS).repartition(5), spark.createDataFrame(labels, LABELS)
    model = T.learn(docs, marks)
    toxic, other, sets, plain, around = brute_counts(rows, labels)
    nt, no = sum(map(len, toxic)), sum(map(len, other))
    assert {e.strip()[:4] for e in model.lexicon} >= {"grun", "snar", "zoun"}
    for entry, weight in model.lexicon.items():
        assert sets[entry] >= T.SUPPORT and len(around[entry]) >= T.SUPPORT
    first = max((e for e in around if sets[e] >= T.SUPPORT and len(around[e]) >= T.SUPPORT), key=lambda e: (len(around[e]) * math.log((len(around[e]) + 0.1) / nt / ((plain[e] + 0.5) / no)), len(e), e))
    assert model.lexicon[first] == pytest.approx(math.log((len(around[first]) + 0.1) / nt / ((plain[first] + 0.5) / no)))
    got = {r.doc_id: r for r in T.score(docs, model).collect()}
    for i, text in rows:
        folded = T.fold(text)
        total, n = sum(brute_hits(folded, model.lexicon, model.exceptions)), len(folded.split())
        a, b, c = model.curve
        assert got[i].score == pytest.approx(1 / (1 + math.exp(-(a * math.log1p(total) + b * math.log1p(100 * total / (n + 10)) + c))))
    assert sum((got[i].score >= 0.5) == bool(x) for i, _, x in labels) >= 0.99 * len(labels)


def test_exceptions_void_an_entry(spark):
    rows, labels = made(600, 5, ("snarfy",))
    calm = [i for i, _, x in labels if not x][::30]
    rows = [(i, t + " a snarfy bird sang" if i in calm else t) for i, t in rows]
    docs = spark.createDataFrame(rows, DOCS)
    model = T.learn(docs, spark.createDataFrame(labels, LABELS))
    assert " snarfy bird " in model.exceptions and any(e.startswith(" snarfy") for e in model.lexicon)
    got = {r.doc_id: r for r in T.score(docs, model).collect()}
    assert all(got[i].score < 0.5 and got[i].terms == [] for i in calm)
    assert all(got[i].score > 0.5 for i, _, x in labels if x)


def test_held_out_texts_and_disguises(spark, tmp_path):
    rows, labels = made(1500)
    rows += [(9000, "the slow snаrfy river runs on and on"), (9001, "people walk in green gruntle fields"), (9002, "such a gruntIe, such a 5narfy"), (9003, None), (9004, ""), (None, "a zounds in spring light"), (9005, "river " * 50_000)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("score", F.lit("x")).withColumn("toxic", F.lit(3)).withColumn("total", F.lit(1))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels + [(None, 1, 1), (3, None, None), (5000, 1, 1)], LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.doc_id: r for r in T.op11_toxicity(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    for i, _, toxic in labels:
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert 0 <= got[i].score <= 1
    assert sum(got[i].predicted == toxic for i, _, toxic in labels if got[i].held_out) >= 0.99 * sum(got[i].held_out for i, _, _ in labels)
    assert got[9000].predicted == 1 and got[9002].predicted == 1 and got[None].predicted == 1 and got[None].held_out is False
    assert got[9003].predicted == got[9004].predicted == got[9005].predicted == 0 and got[9003].score == got[9004].score


def test_order_of_rows_changes_nothing(spark):
    rows, labels = made(300, 2)
    rng = random.Random(1)
    models = []
    for parts in (1, 6):
        rng.shuffle(rows)
        models.append(T.learn(spark.createDataFrame(rows, DOCS).repartition(parts), spark.createDataFrame(labels, LABELS)))
    assert models[0].lexicon == models[1].lexicon and models[0].curve == pytest.approx(models[1].curve)


@pytest.mark.parametrize("labels,want", [([], 0.0), ([(1, 1, 1), (2, 1, 1)], 2.5 / 3), ([(1, 1, 0)], 0.25), ([(1, 1, None)], 0.0)])
def test_labels_missing(spark, labels, want):
    docs = spark.createDataFrame([(1, "a b"), (2, "c"), (3, None)], DOCS)
    model = T.learn(docs, spark.createDataFrame(labels, LABELS))
    assert [r.score for r in T.score(docs, model).collect()] == [pytest.approx(want)] * 3


def test_empty(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 1)], LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    assert T.op11_toxicity(spark, str(tmp_path)).collect() == []


def test_copies_make_no_entries(spark):
    rows, labels = made(300, 3)
    copy = "an odd quixotry text that is copied again and again by somebody"
    rows += [(1000 + k, copy) for k in range(40)]
    labels += [(1000 + k, 1, 1) for k in range(40)]
    model = T.learn(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS))
    assert not any(e.strip() and "quixotry".startswith(e.strip()) for e in model.lexicon)
