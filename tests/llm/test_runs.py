import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from rillflow.llm import runs

SPACE = " \t\n\v\f\r"


def brute_runs(words, least=6, times=4):
    """Every (start, end) that some period fills to its ends, with the smallest period of the stretch."""
    n, found = len(words), {}
    for q in range(1, n // times + 1):
        k = 0
        while k < n - q:
            if words[k] != words[k + q]:
                k += 1
                continue
            start = k
            while k < n - q and words[k] == words[k + q]:
                k += 1
            if k + q - start >= max(least, times * q):
                found.setdefault((start, k + q), q)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def split(text):
    out, word = [], ""
    for c in (text or "") + " ":
        if c in SPACE:
            out += [word] if word else []
            word = ""
        else:
            word += c
    return out


def brute(doc, text):
    words = split(text)
    n = len(words)
    h = zlib.crc32(str(doc).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute_runs(words)
    gone = {k for s, m, q in found for k in range(s + q, s + m)}
    best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc, len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha("".join(f"{s},{m},{q}\n" for s, m, q in found)), sha(" ".join(w for k, w in enumerate(words) if k not in gone)))


@pytest.mark.parametrize("times", [3, 4])
def test_all_short_texts_of_two_words(times):
    for n in range(13):
        for bits in range(2**n):
            words = np.array([bits >> k & 1 for k in range(n)], np.int32)
            assert runs.runs_of(words, 6, times) == brute_runs(words.tolist(), 6, times), words


@pytest.mark.parametrize("times", [3, 4, 5])
def test_random_texts(times):
    rng = random.Random(times)
    for _ in range(600):
        words = []
        while len(words) < rng.randrange(1, 150):
            part = [rng.randrange(rng.choice([2, 3, 30])) for _ in range(rng.randrange(1, 12))]
            words += (part * rng.choice([1, 1, 3, 5, 9]))[: rng.randrange(1, 70)]
        assert runs.runs_of(np.array(words, np.int32), 6, times) == brute_runs(words, 6, times)


def test_long_texts():
    one = np.zeros(60_000, np.int32)
    assert runs.runs_of(one) == [(0, 60_000, 1)]
    part = np.random.default_rng(1).integers(0, 50, 700).astype(np.int32)
    many = np.concatenate([np.arange(1000), np.tile(part, 90)]).astype(np.int32)
    found = runs.runs_of(many)
    assert found == [(1000, 63_000, 700)]
    fib = [[0], [0, 1]]
    while len(fib[-1]) < 5000:
        fib.append(fib[-1] + fib[-2])
    assert runs.runs_of(np.array(fib[-1], np.int32)) == []  # no four-fold repeat in it


def test_bounds_of_arguments():
    with pytest.raises(ValueError):
        runs.runs_of(np.zeros(9, np.int32), 3, 4)


def test_query(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(["a", "b", "ü", "the"][: rng.randrange(1, 5)]) for _ in range(rng.randrange(60)))) for i in range(300)]
    rows += [(i, "\n\tno break here   and\v" * rng.randrange(1, 9)) for i in range(300, 330)]
    rows += [(900, None), (901, ""), (902, " \t\n"), (903, "x " * 30_000), (903, "x " * 30_000), (904, " ".join(map(str, range(20_000))))]
    spark.createDataFrame([(*r, 7, "p") for r in rows], "doc_id long, text string, runs int, best string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, runs.op12_runs(spark, str(tmp_path)).collect()), key=str)
    small = [r for r in rows if r[0] not in (903, 904)]
    big = [r for r in got if r[0] in (903, 904)]
    assert [r for r in got if r not in big] == sorted((brute(*r) for r in small), key=str)
    assert len(big) == 3 and all(r[1:5] == (1, 0, 30_000, 1) for r in big if r[0] == 903)


def test_null_id_and_none(spark, tmp_path):
    spark.createDataFrame([(None, "a b " * 8)], "doc_id long, text string").write.parquet(f"{tmp_path}/a/documents.parquet")
    (row,) = runs.op12_runs(spark, f"{tmp_path}/a").collect()
    assert tuple(row)[:6] == (None, 1, 0, 16, 2, 8000)
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/b/documents.parquet")
    assert runs.op12_runs(spark, f"{tmp_path}/b").collect() == []


def test_real_documents(spark, sf_dir):
    texts = {(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect() if len(r.text or "") < 20_000}
    ids = {d for d, _ in texts}
    got = sorted(tuple(r) for r in runs.op12_runs(spark, sf_dir).collect() if r.doc_id in ids)
    assert got == sorted(brute(d, t) for d, t in texts)


def test_texts_and_spans(docs_of):
    (row,) = runs.find(docs_of([(1, "so it goes go go go go go go on")], extra=True)).collect()
    assert row.collapsed == "so it goes go on" and [tuple(r) for r in row.runs] == [(3, 6, 1)] and row.n_words == 10
