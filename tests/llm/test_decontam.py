import hashlib
import random
import re

import pytest

from rillflow.llm import decontam, tokens

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items):
    windows = {}
    for item, text in items:
        w = words(text)
        if w and item is not None:
            n = min(10, len(w))
            for i in range(len(w) - n + 1):
                windows.setdefault(tuple(w[i : i + n]), set()).add(item)
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for key, ids in windows.items():
            for i in range(len(w) - len(key) + 1):
                if tuple(w[i : i + len(key)]) == key:
                    hit |= set(range(i, i + len(key)))
                    found |= ids
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(found), digest, bool(hit)))
    return sorted(out, key=repr)


def cases():
    rng = random.Random(2)
    vocab = ["Of", "the", "élan", "x9", "ça", "Und", "zu", "kéy", "one", "two"] + [f"v{i}" for i in range(30)]
    text = lambda n: "".join(rng.choice(vocab) + rng.choice([" ", ", ", "\n", "-", "!"]) for _ in range(n))
    items = [(f"i{k}", text(rng.choice([1, 3, 9, 10, 11, 40]))) for k in range(25)] + [("i3", "Of the"), (None, "gone words here"), ("empty", "?!"), ("null", None)]
    docs = []
    for d in range(60):
        parts = [text(rng.randrange(40)), rng.choice(items)[1] or "", text(rng.randrange(10)), (rng.choice(items)[1] or "").upper()]
        docs.append((d, " ".join(parts)))
    return docs + [(100, None), (101, ""), (None, docs[0][1]), docs[1], (102, text(3000))], items


@pytest.mark.parametrize("most", [1 << 24, 100])
def test_digest_matches_brute_force(spark, docs_of, most):
    docs, items = cases()
    bench = spark.createDataFrame([(*i, 1) for i in items], "item_id string, text string, n_words int")
    found = decontam.scan(docs_of(docs, extra=True).select("doc_id", "text", "size"), bench, most=most)
    got = sorted(((r.doc_id, r.n_words, sum(r.hit_words[1::2]) - sum(r.hit_words[::2]), len(r["items"]), hashlib.sha256(",".join(r["items"]).encode()).hexdigest(), bool(r.hit_words)) for r in found.collect()), key=repr)
    assert got == brute(docs, items)
    if most > 100:
        assert sorted(map(tuple, decontam.digest(docs_of(docs), bench).collect()), key=repr) == brute(docs, items)


def test_empty(spark, docs_of):
    none = spark.createDataFrame([], "item_id string, text string")
    assert [tuple(r)[:3] for r in decontam.digest(docs_of([(1, "a b")]), none).collect()] == [(1, 2, 0)]
    assert decontam.digest(docs_of([]), none).count() == 0


def test_removal(spark, docs_of):
    bench = spark.createDataFrame([("a", "uno dos tres cuatro")], "item_id string, text string")
    docs = docs_of([(1, "é before Uno, dos tres; cuatro! after"), (2, "clean uno dos tres"), (3, None)])
    assert sorted((r.doc_id, r.text) for r in decontam.remove_spans(docs, bench).collect()) == [(1, "é before ! after"), (2, "clean uno dos tres"), (3, None)]
    assert sorted(r.doc_id for r in decontam.remove_documents(docs, bench).collect()) == [2, 3]


def test_words_across_passes(monkeypatch):
    monkeypatch.setattr(tokens, "CHUNK", 64)
    text = "a" * 200 + " bb " + "cé" * 90 + " dd" * 50 + "\n" + "e" * 64 + " f"
    w = tokens.words_of(text)
    assert [w.text(i, 1).decode() for i in range(len(w.hash))] == words(text)
    assert len(set(w.hash.tolist())) == len(set(words(text)))
    assert w.hash[-1] == tokens.words_of("f").hash[0] and w.hash[0] == tokens.words_of("a" * 200).hash[0]
