import random
from collections import defaultdict

import numpy as np

import corpus_pipeline as P
from rillflow.llm import nearcopies, simhash


def sets(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def jaccard(a, b):
    return len(a & b) / len(a | b)


def brute_kept(rows, simhash_bits=-1):
    """(no doc_id, doc_id) of the first row of each group: similarity 0.8, or fingerprints of five-word shingles that near."""
    held, fps = [sets(t) for _, t in rows], [simhash.fingerprint(t, 5) for _, t in rows]
    comp = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= simhash_bits or held[i] == held[j] or (held[i] and held[j] and jaccard(held[i], held[j]) >= 0.8):
                comp = [comp[j] if c == comp[i] else c for c in comp]
    groups = defaultdict(list)
    for c, (d, _) in zip(comp, rows):
        groups[c].append((d is None, d or 0))
    return sorted(min(g) for g in groups.values())


def word(rng):
    return "".join(rng.choice("abcdefghij") for _ in range(4))  # no digit, which line dedup reads as a field


def edited(rng, words, edits):
    out = list(words)
    for at in rng.sample(range(len(out)), edits):
        out[at] = "x" + word(rng)
    return " ".join(out)


def corpus(seed=3):
    rng = random.Random(seed)
    rows = []
    for _ in range(12):
        base = [word(rng) for _ in range(rng.choice([40, 200, 900]))]
        rows += [" ".join(base)] * 2 + [edited(rng, base, max(1, round(len(base) * share))) for share in (0.005, 0.01, 0.015, 0.018, 0.02, 0.03, 0.06)]
    rng.shuffle(rows)
    return [*enumerate(rows), (900, None), (901, ""), (902, "a b c"), (903, "A b c")]


def test_edited_copies_go(docs_of):
    """Copies of a similarity of 0.8 or more go although their fingerprints differ in more than three bits."""
    rows = corpus()
    kept = sorted((False, r.doc_id) for r in nearcopies.keep_one(docs_of(rows, extra=True)).collect())
    assert kept == brute_kept(rows, 3)
    alone = {r.doc_id for r in simhash.near_duplicates(docs_of(rows)).where("doc_id = component_id").collect()}
    assert len(alone) > len(kept)


def test_rows_without_or_with_one_id_stay(docs_of):
    rows = [(1, "one text of its own here"), (1, "quite another text under the id"), (None, "no id but clean words"), (None, "no id and other words still"), (None, "one text of its own here")]
    assert sorted((r.text for r in nearcopies.keep_one(docs_of(rows)).collect())) == sorted(t for _, t in rows[:4])


def test_bitmap_never_exceeds_the_difference():
    rng = np.random.default_rng(1)
    a = np.unique(rng.integers(0, 1 << 63, 700).astype(np.uint64))
    b = np.unique(np.r_[a[50:], rng.integers(0, 1 << 63, 60).astype(np.uint64)])
    x, y = (np.frombuffer(nearcopies.bitmap(s), np.uint64) for s in (a, b))
    assert 0 < np.bitwise_count(x ^ y).sum() <= len(np.setxor1d(a, b))
    assert len({*nearcopies.bands(a)} & {*nearcopies.bands(b)}) > 0


def test_pipeline_keeps_no_edited_copy(spark, docs_of, sf_dir):
    docs = docs_of(corpus(5))
    for name, stage in P.STAGES[2:3]:
        docs = stage(spark, docs, sf_dir)
    held = [sets(r.text) for r in docs.collect()]
    assert len(held) > 12
    assert not [1 for i, a in enumerate(held) for b in held[:i] if a and b and jaccard(a, b) >= 0.8]
