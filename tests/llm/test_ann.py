import numpy as np

from rillflow.llm import ann


def frame(spark, vectors, ids=None):
    return spark.createDataFrame([(int(i), None if v is None else [None if x is None else float(x) for x in v], 0) for i, v in zip(ids if ids is not None else range(len(vectors)), vectors)], "vec_id long, embedding array<float>, score int")


def brute(vectors, k=20):
    out = set()
    v = {i: [float(np.float32(x)) for x in x] for i, x in vectors.items()}
    for q in (i for i in v if i % 20 == 0):
        scored = []
        for c in v:
            if c != q and len(v[c]) == len(v[q]):
                s = 0.0
                for a, b in zip(v[q], v[c]):
                    s += a * b
                scored.append((-s, c))
        out |= {(q, r + 1, c, -s) for r, (s, c) in enumerate(sorted(scored)[:k])}
    return out


def result(df):
    v = ann.codes(df)
    return {tuple(r) for r in ann.nearest(v, v.where("vec_id % 20 = 0")).collect()}


def test_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    v = rng.standard_normal((300, 24)) * rng.uniform(0.1, 5, (300, 1))
    v[50:90] = v[50]  # ties
    assert result(frame(spark, v)) == brute(dict(enumerate(v)))


def test_recall_and_bounds():
    rng = np.random.default_rng(5)
    v = rng.standard_normal((3000, 64))
    turn = ann.rotation(64)
    assert np.allclose(turn @ turn.T, np.eye(64))
    queries, length = v[::20], np.linalg.norm(v[::20], axis=1)
    code = ann.encode(v, turn)
    assert code[0].dtype == np.uint64 and code[0].shape == (3000, 8)
    bits, norm, a, largest = code
    est, slack = ann.estimate(bits, norm * largest, a, ann.Rounded(queries @ turn), length)
    wrong = np.abs(est - v @ queries.T) > slack
    assert wrong.mean() < 1e-4 and slack.mean() < 5 * np.abs(est - v @ queries.T).mean() * 2
    reranked = (est + slack >= np.sort(v @ queries.T, axis=0)[-20]).mean()
    assert 0 < reranked < 0.2, "the codes leave most candidates out"
    s = ann.Search(np.arange(0, 3000, 20), queries, 20)
    for i in range(0, 3000, 500):
        rows = np.arange(i, i + 500)
        s.offer(rows, rows, v[i : i + 500], tuple(x[i : i + 500] for x in code))
    exact = v[::20] @ v.T
    exact[np.arange(150), np.arange(0, 3000, 20)] = -np.inf
    want = np.argsort(-exact, axis=1)[:, :20]
    assert np.mean([len(set(a) & set(b)) / 20 for a, b in zip(s.best, want)]) >= 0.99


def test_blocks_of_queries(spark, monkeypatch):
    rng = np.random.default_rng(4)
    v = rng.standard_normal((200, 8))
    want = brute(dict(enumerate(v)))
    monkeypatch.setattr(ann, "BLOCK_BYTES", 200)
    monkeypatch.setattr(ann, "UNION", 3)
    assert result(frame(spark, v)) == want


def test_edges(spark):
    v = [[1, 0], None, [0, 0], [np.nan, 1], [None, 1], [np.inf, 1], [], [2, 0], [1, 0, 0], [3, 0, 1]]
    ids = [0, 1, 2, 3, 4, 5, 6, 7, 20, 9]
    extra = [(0, [1, 0]), (7, [2, 0])]
    df = frame(spark, v + [x for _, x in extra], ids + [i for i, _ in extra])
    assert result(df) == {(0, 1, 7, 2.0), (0, 2, 7, 2.0), (0, 3, 0, 1.0), (20, 1, 9, 3.0)}
    coded = ann.codes(df)
    assert ann.nearest(coded, coded.where("vec_id % 20 = 0")).count() == 7, "each row of a repeated vec_id is a query and a candidate"
    assert result(frame(spark, [])) == set()


def large(spark, vectors):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")


def plain(vectors, k=20):
    """As ``brute``, in double precision; no number comes before all numbers."""
    out = []
    for q in range(0, len(vectors), 20):
        scored = []
        for c in range(len(vectors)):
            s = 0.0
            for a, b in zip(vectors[q], vectors[c]):
                s += float(a) * float(b)
            scored += [((0, 0.0) if s != s else (1, -s), c, s)] if c != q else []
        out += [(q, r + 1, c, str(s)) for r, (_, c, s) in enumerate(sorted(scored)[:k])]
    return sorted(out)


def test_components_of_any_finite_size(spark):
    rng = np.random.default_rng(6)
    base = rng.standard_normal((160, 12))
    mixed = base * 10.0 ** rng.choice([-155, 0, 155], (160, 1))
    queries_small = base * np.where(np.arange(160) % 20 == 0, 1e-155, 1e155)[:, None]
    for v in (mixed, queries_small, base * 1e200, base * 1e-200, base * 1e-310, np.abs(base) * 1e160, np.where(np.arange(160)[:, None] % 3 == 0, np.abs(base) * 1e300, base)):
        coded = ann.codes(large(spark, v))
        got = sorted((r.query_id, r.rank, r.vec_id, str(r.score)) for r in ann.nearest(coded, coded.where("vec_id % 20 = 0")).collect())
        assert got == plain(v)
