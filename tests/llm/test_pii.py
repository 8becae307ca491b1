import hashlib
import random
import re

import pytest

from rillflow.llm import pii

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    s = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (2 if i % 2 else 1)
        s += x - 9 if x > 9 else x
    return s % 10 == 0


def brute(text):
    out = []
    for k, (kind, p) in enumerate(BASE.items()):
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m[0].split(".")), "card": lambda: 14 <= len(d) <= 19 and luhn(d), "phone": lambda: 10 <= len(d) <= 15}[kind]
            if ok():
                out.append((m.start(), k, m.end()))
    return sorted(out)


CASES = [
    "a@b.c_d@e.f g@h i@j.k.l. @m.n o@@p.q r@s..t é@u.v", "x" * 300 + "@" + "y" * 50 + ".z", "1.2.3.4.5.6.7.8 256.1.1.1 01.002.0003.255 1.2.3 9.9.9.9.",
    "4539 1488 0343 6467 4539-1488-0343-6467 45391488034364670 79927398713 1 2 3", "+1 (555) 123-4567 ++49 30 901820 +1 2 +12345678901234567 +1-", "4539148803436467+15551234567 a1@b.co/1.1.1.1",
]


@pytest.mark.parametrize("text", [*CASES, "", None])
def test_base_spans(text):
    assert pii.base_spans(text or "") == brute(text)


def test_base_spans_on_noise():
    rng = random.Random(7)
    for _ in range(400):
        text = "".join(rng.choice("0123456789..@@+- ()ab_é\n") for _ in range(rng.randrange(80)))
        assert pii.base_spans(text) == brute(text), text


def test_long_texts_take_linear_time():
    import time

    start = time.time()
    for text in ("1" * 400_000, "a" * 400_000 + "@", "1." * 200_000, "+1 " * 150_000, "1 " * 200_000, "@" * 400_000):
        pii.base_spans(text)
        list(pii.instances(text, []))
    assert time.time() - start < 20


def text_of(spans):
    return ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans)


def test_query_columns(spark, docs_of, tmp_path):
    rows = [(i, t) for i, t in enumerate(CASES)] + [(90, None), (91, ""), (None, CASES[0]), (0, CASES[0])]
    docs_of(rows, extra=True).write.parquet(str(tmp_path / "documents.parquet"))
    got = pii.op10_pii(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    want = sorted((d, text_of(brute(t))) for d, t in rows if d is not None)
    assert sorted((r.doc_id, r.spans) for r in got if r.doc_id is not None) == want
    for r in got:
        spans = brute(dict(rows)[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(text_of(spans).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == j for _, k, _ in spans) for j in range(4)]


def card(rng):
    body = "".join(str(rng.randrange(10)) for _ in range(15))
    return next(body + d for d in "0123456789" if luhn(body + d))


def bootstrapped(rows):
    """Accepted patterns by the rule of the docstring, in plain loops over the instances of all documents."""
    edges = {}
    for _, text in rows:
        for *_, made, instance, kind in pii.instances(text or "", brute(text)):
            for p in made:
                edges[p, instance] = max(kind, edges.get((p, instance), -1))
    seeds = {}
    for (_, i), k in edges.items():
        if k >= 0:
            seeds[i] = (max(k, seeds.get(i, (-1,))[0]), 1.0)
    trust, good = dict(seeds), {}
    for _ in range(pii.ROUNDS):
        good = {}
        for p in {p for p, _ in edges}:
            own = [i for q, i in edges if q == p]
            backed = [trust[i] for i in own if i in trust]
            score = sum(t for _, t in backed) / (len(own) + 1)
            if len(backed) >= pii.SUPPORT and len({k for k, _ in backed}) == 1 and score >= pii.ACCEPT:
                good[p] = (backed[0][0], score)
        trust = dict(seeds)
        for (p, i), k in edges.items():
            if k < 0 and p in good and i not in seeds:
                trust[i] = max(trust.get(i, (-1, -1)), good[p], key=lambda x: x[1])
    return {p: k for p, (k, _) in good.items()}


def brute_spans(text, good):
    base = brute(text)
    new = [(a, next(good[p] for p in made if p in good), b) for a, b, made, _, k in pii.instances(text or "", base) if k < 0 and any(p in good for p in made)]
    kept = []
    for s in sorted(new, key=lambda s: (s[0], -s[2])):
        if all(s[0] >= q[2] for q in kept):
            kept.append(s)
    return sorted(base + kept)


def corpus():
    rng = random.Random(4)
    rows = [(i, f"contact line +49 30 9018{i:04d} today") for i in range(40)] + [(i + 50, f"login from 10.0.{i}.7 seen") for i in range(40)]
    rows += [(i + 200, f"word{rng.choice('abcdefgh')} {card(rng)} and more") for i in range(30)] + [(i + 300, f"w {rng.randrange(10**15, 10**16)} w") for i in range(30)]
    rows += [(100, "login from 10.0.999.7 seen"), (101, "page from chapter 123456 clean"), (102, "clean text"), (103, None)]
    return [*rows, (104, f"two {card(rng)} {card(rng)} cards"), (105, "call +49 30 90187777 10.1.2.3 now"), (106, 'mail "a@b.co", a1@b.co; a2@b.co')]


@pytest.mark.parametrize("most", [100_000, 0])
def test_patterns_add_unseen_identifiers(docs_of, monkeypatch, most):
    monkeypatch.setattr(pii, "MOST_PATTERNS", most)
    rows = corpus()
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in pii.find(docs_of(rows)).collect()}
    good, text = bootstrapped(rows), dict(rows)
    assert got == {d: brute_spans(t, good) for d, t in rows}
    for d, t in rows:
        assert set(brute(t)) <= set(got[d])
    assert got[100] == [(11, 1, 21)], "a context finds what no expression matches"
    assert got[101] == got[102] == got[103] == []
    assert brute(text[104]) == [] and got[104] == [(4, 2, 20), (21, 2, 37)], "cards that run into each other"
    assert (5, 3, 20) not in brute(text[105]) and (5, 3, 20) in got[105], "a phone number before an address"
    assert all(got[d] == brute(text[d]) for d in range(300, 330)), "numbers that fail the checksum stay unmarked"


def test_whole_contexts_count(docs_of):
    """Words and shapes that differ only far from the identifier are different patterns."""
    far, near = "x" * 90, "y" * 90
    rows = [(i, f"{far}from 10.0.{i}.7 seen") for i in range(40)] + [(50, f"{far}from 10.0.999.7 seen"), (51, f"{near}from 10.0.999.7 seen")]
    got = {r.doc_id: len(r.spans) for r in pii.find(docs_of(rows)).collect()}
    assert got[50] == 1 and got[51] == 0


def test_empty(docs_of):
    assert pii.find(docs_of([])).count() == 0
