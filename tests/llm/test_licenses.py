import random

import pytest

from rillflow.llm import licenses, tokens

T = licenses.TEMPLATES


def scan(docs, **kw):
    return sorted(((r.doc_id, r.license_id, round(r.coverage, 4), r.start, r.end) for r in licenses.scan(docs, **kw).collect()), key=repr)


def words(n, seed):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefé") for _ in range(6)) for _ in range(n))


def test_whole_templates_are_found(docs_of):
    rows, want = [], []
    for i, (name, text) in enumerate(sorted(T.items())):
        lead = words(30, i) + "\n"
        rows.append((i, lead + text + "\n" + words(20, i + 99)))
        body = text.rstrip('.!?")/')
        want.append((i, name, 1.0, len(lead), len(lead) + len(body)))
    got = scan(docs_of(rows, extra=True))
    assert set(want) <= set(got)
    assert all(c >= 0.8 for _, _, c, *_ in got)


def test_changed_templates_by_alignment(docs_of):
    text = T["mit-grant"].split()
    one = [*text[:20], "EXTRA", "WORDS", *text[20:40], *text[45:]]
    got = scan(docs_of([(1, "pre " + " ".join(one) + " post"), (2, " ".join(text[: len(text) // 2]))]))
    assert [g[:2] for g in got] == [(1, "mit-grant")]
    n = len(tokens.words_of(T["mit-grant"]).hash)
    gone = len(tokens.words_of(" ".join(text[40:45])).hash)
    assert got[0][2] == pytest.approx((n - gone) / n, abs=1e-3)


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def test_banded_alignment_against_brute_force():
    import numpy as np

    rng = random.Random(3)
    for _ in range(100):
        a = np.array([rng.randrange(1, 6) for _ in range(rng.randrange(1, 12))], np.uint64)
        b = np.array([rng.randrange(1, 6) for _ in range(rng.randrange(1, 10))], np.uint64)
        n, x, y = licenses._banded(a, np.concatenate([np.zeros(licenses.BAND, np.uint64), b]))
        if len(b) <= licenses.BAND and len(a) <= licenses.BAND:
            assert n == lcs(a.tolist(), b.tolist())
        assert n <= y - x or n == 0


def test_winnowing_keeps_one_of_each_window():
    import numpy as np

    h = np.random.default_rng(1).integers(0, 50, 200).astype(np.uint64)
    kept = licenses.winnowed(h)
    for i in range(len(h) - licenses.WINNOW + 1):
        assert any(i <= k < i + licenses.WINNOW and h[k] == h[i : i + licenses.WINNOW].min() for k in kept)


def test_edges(docs_of):
    notice = "Released under the MIT License."
    rows = [(1, None), (2, ""), (None, notice), (3, notice), (3, notice), (4, "x " * 100_000 + notice), (5, notice + " " + notice), (6, "MIT License")]
    got = scan(docs_of(rows))
    assert [g[0] for g in got if g[1] == "mit-notice"] == [3, 3, 4, 5, 5, None]
    assert scan(docs_of([])) == [] and scan(docs_of(rows), templates={}) == []


def subsequence(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def test_whole_operator_against_unbanded_alignment(docs_of):
    """Edited copies of templates among words that no template has: coverage and span as an alignment with the whole document gives them."""
    import random

    rng = random.Random(12)
    templates = {f"t{k}": " ".join(f"k{k}w{j}" for j in range(n)) for k, n in enumerate((1, 2, 3, 6, 15, 40, 90))}
    templates["none"] = "?!"
    rows, want = [], set()
    for d in range(120):
        name = rng.choice([f"t{k}" for k in range(7)])
        words = templates[name].split()
        copy = list(words)
        for _ in range(rng.randrange(0, max(1, len(words) // 5))):
            at = rng.randrange(len(copy))
            copy[at : at + rng.randrange(2)] = ["edit"] * rng.randrange(2)
        left, right = (["fill\u00e9r", "other"] * rng.randrange(20) for _ in range(2))
        text = " ".join([*left, *copy, *right])
        rows.append((d, text))
        n = subsequence(words, text.split())
        shingles = {tuple(words[i : i + 3]) for i in range(len(words) - 2)} & {tuple(copy[i : i + 3]) for i in range(len(copy) - 2)}
        if n / len(words) >= 0.8 and (shingles or len(words) < 3):
            own = [i for i, w in enumerate(copy) if w in words]
            start = len(" ".join([*left, *copy[: own[0]], ""]))
            want.add((d, name, round(n / len(words), 6), start, start + len(" ".join(copy[own[0] : own[-1] + 1]))))
    got = {(r.doc_id, r.license_id, round(r.coverage, 6), r.start, r.end) for r in licenses.scan(docs_of(rows), templates).collect()}
    assert len(want) > 60 and got <= want
    assert len(want - got) <= 0.02 * len(want), "a copy whose kept fingerprints are all edited is no candidate"


def test_many_matches_in_a_long_text_take_linear_time():
    import time

    notice = licenses.TEMPLATES["mit-notice"]

    start = time.time()
    index, w = licenses.Index(licenses.TEMPLATES), licenses.tokens.words_of((notice + " \u00e9 filler words between ") * 20_000)
    found = sum(1 for _ in index.candidates(w))
    assert found >= 20_000 and time.time() - start < 20


def test_matches_in_a_long_text(docs_of):
    notice = licenses.TEMPLATES["mit-notice"]
    got = licenses.scan(docs_of([(1, (notice + " \u00e9 filler words between them ") * 3000)])).where("license_id = 'mit-notice'").collect()
    step = len(notice) + len(" \u00e9 filler words between them ")
    assert sorted(r.start for r in got) == [k * step for k in range(3000)]
