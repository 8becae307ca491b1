import random
import re

import numpy as np
import pytest
import xxhash

from rillflow.llm import simhash


def brute_fingerprint(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_components(rows):
    fps = [brute_fingerprint(t) for _, t in rows]
    comp = list(range(len(rows)))

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                comp[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted(((d, f"{fps[i]:016x}", least.get(root(i))) for i, (d, _) in enumerate(rows)), key=repr)


def result(df):
    found = simhash.near_duplicates(df).collect()
    return sorted(((r.doc_id, f"{r.fp & (1 << 64) - 1:016x}", r.component_id) for r in found), key=repr)


def test_fingerprint_matches_brute_force():
    rng = random.Random(3)
    for n in (0, 1, 2, 3, 4, 50, 700):
        text = " ".join(rng.choice(["Ab", "cé", "ÉX", "d,", "e f", " z"]) for _ in range(n)) + "\n"
        assert simhash.fingerprint(text) == brute_fingerprint(text)
    long = "word Other " * 70_000
    assert simhash.fingerprint(long) == brute_fingerprint("word Other " * 70_000)


def test_components_match_brute_force(docs_of):
    rng = random.Random(5)
    rows = []
    for base in range(12):
        words = [f"w{rng.randrange(5000)}" for _ in range(400)]
        for _ in range(rng.randrange(1, 12)):
            new = list(words)
            for _ in range(rng.randrange(3)):
                new[rng.randrange(len(new))] = f"x{rng.randrange(99)}"
            rows.append((len(rows) * 7 % 1000, " ".join(new)))
    rows += [(5000, None), (5001, ""), (5002, " \n"), (None, "a b"), (None, rows[0][1]), rows[3], (5003, "One"), (5004, "one")]
    assert result(docs_of(rows, extra=True)) == brute_components(rows)
    assert len({c for *_, c in brute_components(rows)}) < len(rows) / 2


@pytest.mark.parametrize("segment", [0, 1])
def test_big_groups_lose_no_link(segment, monkeypatch):
    rng = random.Random(8)
    other = {0xABCD1234}
    while len(other) < 300:
        other.add(rng.choice(sorted(other)) ^ 1 << rng.randrange(32))
    own, shift = 0x13579BDF, 32 * segment
    held = [own << shift | x << (32 - shift) for x in sorted(other)[::2]]
    probe = [(own ^ 1 << rng.randrange(32)) << shift | x << (32 - shift) for x in sorted(other)[1::2]]
    fp, flag = np.array(held + probe, np.uint64), np.array([False] * len(held) + [True] * len(probe))
    want = {(a, b) for a in held + probe for b in held if a != b and (a ^ b).bit_count() <= 3}
    got = {(int(a), int(b)) for x, y in simhash._big_group(fp, flag, segment) for a, b in zip(x, y) if a != b}
    assert want and got == want
    few = {(int(a), int(b)) for x, y in simhash._links(np.full(len(fp), segment << 32), fp, flag) for a, b in zip(x, y)}
    assert {frozenset(p) for p in few} == {frozenset(p) for p in want}
    monkeypatch.setattr(simhash, "_PAIRS", 1000)
    some = {(int(a), int(b)) for x, y in simhash._links(np.full(len(fp), segment << 32), fp, flag) for a, b in zip(x, y)}
    assert {frozenset(p) for p in some} == {frozenset(p) for p in want}


@pytest.mark.parametrize("rows", [[], [(1, None)], [(None, None), (None, "")]])
def test_edges(rows, docs_of):
    assert result(docs_of(rows)) == brute_components(rows)


def test_keep_one(docs_of):
    kept = simhash.keep_one(docs_of([(3, "a b c d"), (2, "a b c d"), (9, "completely different words in here"), (2, "a b c d")]))
    assert sorted(r.doc_id for r in kept.collect()) == [2, 9]
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_keep_one_loses_no_text(docs_of):
    """Rows without doc_id, and unlike rows of one doc_id, are rows like others."""
    rows = [(None, "a text without id stands here"), (None, "another text, and again no id"), (None, "a text without id stands here"), (4, "one text of the id four"), (4, "something else under this id"), (7, "a text without id stands here"), (None, None), (8, "")]
    kept = sorted(((r.doc_id, r.text) for r in simhash.keep_one(docs_of(rows, extra=True), 5).collect()), key=repr)
    assert kept == sorted([(None, rows[1][1]), rows[3], rows[4], rows[5], (8, "")], key=repr)
