import random
import re
from collections import Counter, defaultdict

import pytest

from rillflow.llm import mixing


def size_of(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def brute_targets(sizes):
    """Reshare until none is above its cap."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    cap, total = {s: 3.0 * sizes[s] for s in names}, sum(sizes.values())
    held, free = {}, set(names)
    while free:
        left, w = total - sum(held.values()), sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / w > cap[s]]
        if not over:
            return held | {s: left * weight[s] / w for s in free}
        for s in over:
            held[s] = cap[s]
            free.remove(s)
    return held




def corpus(n=400, seed=4):
    rng = random.Random(seed)
    names = ["src0"] * 6 + ["a", "b", "é", "z", "Z", "tiny", None]
    rows = [(i, " ".join("w" * rng.randrange(1, 5) for _ in range(1 if s == "tiny" else rng.choice([0, 1, 5, 40, 300]))), "en", s) for i in range(n) for s in [rng.choice(names)]]
    return [*rows, (n, None, "en", "a"), (n + 1, " \n\t", "en", "onlyempty"), (None, "null id here", "en", "a"), rows[0], (n + 2, "long " * 20_000, "en", "b")]


def test_mix(docs_of):
    rows = corpus()
    got = mixing.mix(docs_of(rows, extra=True)).collect()
    assert mixing.mix(docs_of(rows)).columns == ["doc_id", "size", "source_size", "target", "taken"]
    assert Counter((r.doc_id, r["size"]) for r in got) == Counter((d, size_of(t)) for d, t, *_ in rows)
    sizes = defaultdict(int)
    for _, t, _, s in rows:
        sizes[s] += size_of(t)
    want = brute_targets(dict(sizes))
    source = {r[0]: r[3] for r in rows}
    taken = defaultdict(int)
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == sizes[s]
        assert r.target == pytest.approx(want[s])
        assert 0 <= r.taken <= 3 * r["size"]
        taken[s] += r.taken
    for s, t in taken.items():
        assert abs(t - want[s]) <= max(0.02 * want[s], 2 * mixing.BLOCK), s
    assert sum(want.values()) == pytest.approx(sum(sizes.values()))


def test_reruns_agree(docs_of):
    rows = corpus(120, 9)
    one = sorted(map(tuple, mixing.mix(docs_of(rows)).collect()), key=repr)
    two = sorted(map(tuple, mixing.mix(docs_of(rows[::-1]).repartition(3)).collect()), key=repr)
    assert one == two


def test_slots_are_permutations(docs_of):
    sources = mixing.targets(mixing.sizes(docs_of(corpus())))
    n = {r["rank"]: r.blocks for r in sources.collect()}
    by = defaultdict(list)
    for r in mixing.slots(sources).collect():
        by[r["rank"], r.slot // n[r["rank"]]].append(r.block)
    for (rank, _), blocks in by.items():
        assert len(set(blocks)) == len(blocks) and set(blocks) <= set(range(n[rank]))


def test_counts_are_drawn_for_shards_and_filled(spark, docs_of, monkeypatch):
    """Each shard holds as many slots of a source as were drawn for it, and the draws of a source add up to its slots."""
    monkeypatch.setattr(mixing, "SHARD_SLOTS", 100)
    sources = mixing.targets(mixing.sizes(docs_of(corpus())))
    counts = {(r["rank"], r.shard): r["count"] for r in mixing.shard_counts(sources).collect()}
    total, made = Counter(), Counter((r["rank"], r.shard) for r in mixing.slots(sources).collect())
    assert made == counts and len({k for _, k in counts}) > 5
    for (rank, _), c in counts.items():
        total[rank] += c
    assert total == {r["rank"]: r["slots"] for r in sources.where("slots > 0").collect()}
    # as a multinomial draw scatters: the largest source, over the shards, by its variance
    rank, n = total.most_common(1)[0]
    shards = max(k for _, k in counts) + 1
    chi = sum((counts.get((rank, k), 0) - n / shards) ** 2 / (n / shards) for k in range(shards))
    assert 0.2 * shards < chi < 3 * shards


@pytest.mark.parametrize("n", [1, 2, 3, 5, 7, 12, 97, 1000, 4099])
def test_permutation(spark, n):
    from pyspark.sql import functions as F

    made = spark.range(3 * n).select(mixing._permuted(F.col("id"), F.lit(n).cast("long"), F.lit(3).cast("long")).alias("p"), "id").orderBy("id").collect()
    passes = [[r.p for r in made[k * n : (k + 1) * n]] for k in range(3)]
    assert all(sorted(p) == list(range(n)) for p in passes)
    if n >= 97:
        assert passes[0] != passes[1] and len({(b - a) % n for a, b in zip(passes[0], passes[0][1:])}) > n // 3  # no equal strides


def test_shards_hold_the_mix(docs_of, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_SLOTS", 50)
    rows = [(i, f" d{i}" + "".join(f" {i}w{k}" + "\n" * (k % 7 == 0) for k in range(n)), "en", s) for i, (n, s) in enumerate([(2000, "a"), (700, "b"), (40, "b"), (900, "c"), (90, None), (1, "a")] * 3)]
    docs = docs_of(rows)
    got = mixing.shards(docs).collect()
    assert all(size_of(r.text) <= mixing.BLOCK for r in got) and len({r.shard for r in got}) > 3
    assert len({(r.shard, r.place) for r in got}) == len(got)
    words, want = Counter(), Counter()
    for r in got:
        words.update((r.source, w) for w in r.text.split())
    for r in mixing.emit(docs).collect():
        want.update((r.source, w) for w in r.text.split())
    assert words == want


def test_taken_matches_brute_force(spark, docs_of):
    docs = docs_of(corpus(80, 11))
    sized = mixing.sizes(docs)
    sources = mixing.targets(sized)
    placed = mixing.layout(sized, sources).collect()
    taken = Counter()
    for slot in mixing.slots(sources).collect():
        lo, hi = slot.block * mixing.BLOCK, (slot.block + 1) * mixing.BLOCK
        for p in placed:
            if p["rank"] == slot["rank"]:
                taken[p["rank"], p.lane, p.pos] += max(0, min(hi, p.start + p["size"]) - max(lo, p.start))
    want = sorted(((p.doc_id, p["size"], taken[p["rank"], p.lane, p.pos]) for p in placed), key=repr)
    assert sorted(((r.doc_id, r["size"], r.taken) for r in mixing.mix(docs).collect()), key=repr) == want


def test_one_source_and_empty(docs_of):
    rows = [(1, "a b c", "en", "x"), (2, "d", "en", "x")]
    assert sorted(r.taken for r in mixing.mix(docs_of(rows)).collect()) == [1, 3]
    assert mixing.mix(docs_of([])).count() == 0
    assert [tuple(r) for r in mixing.mix(docs_of([(1, None, None, None)])).collect()] == [(1, 0, 0, 0.0, 0)]


def test_emit_holds_what_is_taken(docs_of):
    """Texts hold the words taken, with repeats, so sources come out on target."""
    rows = [(i, f" d{i}" + "".join(f" {i}w{k}" + "\n" * (k % 7 == 0) for k in range(n)), "en", s) for i, (n, s) in enumerate([(2000, "a"), (700, "b"), (40, "b"), (900, "c"), (90, "c"), (1, "a")] * 3)]
    docs = docs_of(rows)
    want = brute_targets({s: sum(size_of(t) for _, t, _, x in rows if x == s) for s in "abc"})
    digest = {r.doc_id: r.taken for r in mixing.mix(docs).collect() if r.taken}
    got = mixing.emit(docs).collect()
    texts, words = {r[0]: r[1] for r in rows}, Counter()
    for r in got:
        assert size_of(r.text) == r.taken and r.n_chars == len(r.text)
        own = Counter(texts[r.doc_id].split())
        assert all(n <= 3 * own[w] for w, n in Counter(r.text.split()).items())
        words[r.source] += size_of(r.text)
    assert {r.doc_id: r.taken for r in got} == digest
    for s, t in want.items():
        assert abs(words[s] - t) <= max(0.02 * t, 2 * mixing.BLOCK), s


def test_emit_tells_rows_of_one_id_apart(docs_of):
    rows = [(1, "a b c d", "en", "x"), (1, "e f g", "en", "x"), (None, "h i", "en", "x"), (1, "a b c d", "en", "x"), (2, None, "en", "x")]
    got = Counter(w for r in mixing.emit(docs_of(rows, extra=True)).collect() for w in r.text.split())
    assert got == Counter("abcdabcdefghi")


def test_taken_text(spark):
    from pyspark.sql import functions as F

    def made(text, *parts):
        held = F.array(*(F.struct(*(F.lit(v).cast("long").alias(n) for n, v in zip(("first", "words", "uses"), p))) for p in parts))
        return spark.createDataFrame([(text,)], "text string").select(mixing._taken_text(F.col("text"), held)).first()[0]

    text = " one two\nthree  four five"
    assert made(text, (0, 2, 1), (2, 1, 2), (4, 1, 1)) == "one two\nthree\nfive\nthree"
    assert made(text, (0, 5, 1)) == "one two\nthree  four five"
    assert made("a \n\n b  c \n", (0, 1, 2), (1, 2, 2)) == "a \n\n b  c\na \n\n b  c"
    assert made("a \nb \n\nc d", (0, 3, 1), (3, 1, 1)) == "a \nb \n\nc d"
    assert size_of(made("w " * 100_000, *((i, 32, 1) for i in range(0, 99_000, 64)))) == 1547 * 32


def test_sources_without_number_end_in_targets(docs_of):
    """Hundreds of sources, with ties in name order and in size: as the brute force shares."""
    rng = random.Random(6)
    rows = [(i, "w " * rng.choice([0, 1, 1, 2, 50, 400]), "en", f"s{rng.randrange(300)}") for i in range(900)]
    sizes = defaultdict(int)
    for _, t, _, s in rows:
        sizes[s] += size_of(t)
    want = brute_targets(dict(sizes))
    got = {r.source: r.target for r in mixing.targets(mixing.sizes(docs_of(rows))).collect()}
    assert got == pytest.approx(want)


def test_pipeline_returns_the_mix(spark, sf_dir):
    import corpus_pipeline as P

    out = P.run(spark, sf_dir).select("text", "taken").collect()
    assert out and all(size_of(r.text) == r.taken for r in out)
