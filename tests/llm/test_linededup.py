import random
from collections import defaultdict

import pytest

from rillflow.llm import linededup


def shapes(line):
    """The templates of a line by the rule of the docstring, as tuples of tokens."""
    words = ["<*>" if any(c in "0123456789" for c in w) else w for w in line.split()]
    n, rest = len(words), words[2:]
    if not n:
        return set()
    cuts = [len(rest) * k // 4 for k in range(5)]
    stretches = [tuple(words[:2]), *(tuple(rest[a:b]) for a, b in zip(cuts, cuts[1:]))]
    wild = [()] + ([(k,) for k in (1, 2, 3, 4)] if n >= 8 else []) + ([(0,), *((a, b) for a in range(5) for b in range(a))] if n >= 16 else [])
    return {(n, frozenset(w), *("any" if k in w else x for k, x in enumerate(stretches))) for w in wild}


def brute(rows, min_docs):
    docs, first = defaultdict(set), {}
    for k, (d, t) in enumerate(rows):
        for line in (t or "").split("\n"):
            for key in shapes(line):
                docs[key].add(k)
                if d is not None:
                    first[key] = min(first.get(key, d), d)
    out = []
    for d, t in rows:
        keep = [line for line in (t or "").split("\n") if not any(len(docs[k]) >= min_docs and first.get(k, d) != d for k in shapes(line))]
        out.append((d, t if t is None else "\n".join(keep)))
    return sorted(out, key=repr)


def corpus():
    rng = random.Random(8)
    word = lambda: f"w{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}"
    line = lambda n: " ".join(word() for _ in range(n))
    shared = [line(n) for n in (2, 5, 9, 60)]
    log = "Request {} from host {} took a while and was then served by the usual machine"
    rows = []
    for i in range(60):
        parts = [line(rng.randrange(1, 30)) for _ in range(3)] + rng.sample(shared, 2) + [log.format(i, f"10.0.0.{i}"), "", "  "]
        rng.shuffle(parts)
        rows.append((i, "\n".join(parts)))
    near = line(24).split()
    for i in range(15):  # differ in one word of the last stretch
        rows.append((200 + i, " ".join([*near[:-2], word(), near[-1]])))
    for i in range(15):  # differ in two places, the leading tokens or a stretch each
        new = list(near)
        for at in rng.sample((0, 1, 4, 9, 15, 22), 1 + i % 2):
            new[at] = word()
        rows.append((300 + i, "w" + " ".join(new)))
    return rows + [(100, None), (101, ""), (None, shared[0] + "\nown line of the nameless"), rows[0], (102, "big " * 50_000 + "\n" + shared[3])]


@pytest.mark.parametrize("most", [10**6, 0])
def test_matches_brute_force(docs_of, most):
    rows = corpus()
    got = linededup.drop_lines(docs_of(rows, extra=True), 10, most)
    assert got.columns[-2:] == ["n_lines", "n_dropped"]
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=repr) == brute(rows, 10)


def test_variable_fields_share_templates():
    assert linededup.templates("took 15 ms at 10.0.0.1")[0] == linededup.templates("took 7 ms at host3")[0]
    a, b = linededup.templates("one two three four five six seven eight nine ten"), linededup.templates("one two three four five six seven eight nine ELEVEN")
    assert a[0] != b[0] and set(a) & set(b)
    assert not set(a) & set(linededup.templates("one two X four five six seven eight nine ELEVEN"))
    long = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen".split()
    edited = lambda *at: " ".join("XY" if k in at else w for k, w in enumerate(long))
    base = set(linededup.templates(" ".join(long)))
    assert base & set(linededup.templates(edited(0, 17))) and base & set(linededup.templates(edited(3, 4, 9))) and base & set(linededup.templates(edited(1)))
    assert not base & set(linededup.templates(edited(3, 9, 17)))
    assert linededup.templates("") == linededup.templates(" \t") == []


def test_clean(docs_of):
    rows = [(i, "the shared line\nown text " + "abc"[i % 3] * (i + 1), "en", "s", 5) for i in range(12)] + [(i, "the shared line", "en", "s", 5) for i in range(20, 25)] + [(50, "fine", None, None, 4), (51, None)]
    kept = {r.doc_id: r for r in linededup.clean(docs_of(rows)).collect()}
    assert set(kept) == {*range(12), 50, 51}
    assert kept[0].text.startswith("the shared") and kept[1].text == "own text bb" and kept[1].n_chars == 11 and kept[50].n_chars == 4
    assert linededup.clean(docs_of([])).count() == 0
