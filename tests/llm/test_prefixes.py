import hashlib
import math
import random
import zlib
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from rillflow.llm import prefixes

SCHEMA = "conv_id long, turn long, role string, text string"
NAMES = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()


def brute_trie(convs):
    """Nodes of {conv_id: tuple of turns}, each turn with its text last."""
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    out = []
    for p, own in members.items():
        under = [q for q in members if q[: len(p)] == p]
        ends = ",".join(map(str, sorted(c for c in own if convs[c] == p)))
        out.append((
            min(own), len(p), min(members[p[:-1]]) if p else None, len(own), sum(len(q) == len(p) + 1 for q in under),
            sum(not any(x[: len(q)] == q and len(x) > len(q) for x in under) for q in under), sum((len(members[q]) - 1) * len(q[-1][-1]) for q in under if q), hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(out, key=repr)


def brute(rows):
    own = {}
    digest = lambda r: hashlib.sha256(f"{len(r[2] or '')}:{r[2] or ''}{r[3] or ''}".encode()).digest()
    for r in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[1] is not None, r[1] or 0, digest(r))):
        own.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    convs = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        convs[c] = tuple(own.get(c - int(math.fmod(c, 100)), [])[:h] + turns[h:])
    return brute_trie(convs)


def found(df):
    return sorted((tuple(r[n] for n in NAMES) for r in df.collect()), key=repr)


def talk(rng, n, most, words=3):
    return [(c, t, rng.choice(["user", "bot", None]), rng.choice(["", "é" * 3, "hello", None, "x"][:words])) for c in range(n) for t in range(rng.randrange(1, most))]


@pytest.mark.parametrize("local", [1, 7, 40, 100_000])
def test_any_split_gives_the_same_trie(spark, local):
    rng = random.Random(local)
    rows = talk(rng, 260, 7) + [(c, t, "user", "the same opening") for c in range(300, 340) for t in range(9)] + [(c, 9, "user", str(c % 5)) for c in range(300, 338)]
    made, _ = prefixes.sequences(spark.createDataFrame(rows, SCHEMA).repartition(7))
    whole = {}
    for r in sorted(rows, key=lambda r: r[:2]):
        whole.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    assert found(prefixes.trie(made, local)) == brute_trie({c: tuple(t) for c, t in whole.items()})


def test_query(spark, tmp_path):
    rng = random.Random(3)
    rows = talk(rng, 450, 8, 5)
    rows += [(c, None, "user", "before") for c in range(0, 450, 7)] + rows[:50] + [(None, 1, "user", "nobody's"), (1001, 1, "a", "b"), (-5, 1, "u", "x"), (-105, 1, "u", "y"), (-100, 2, "u", "z"), (70_000, 1, "u", "far"), (10**15, 1, None, None)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("ids", F.lit(1)).withColumn("least", F.lit("p")).withColumn("key", F.lit(None).cast("int"))
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    got = found(prefixes.op13_prefixes(spark, str(tmp_path)))
    assert got == brute(rows)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    assert sorted(con.sql(f"SELECT {', '.join(NAMES)} FROM ({prefixes.OP13_SQL})").fetchall(), key=repr) == got


def test_empty(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    assert found(prefixes.op13_prefixes(spark, str(tmp_path))) == []


def test_long_conversations_and_many_copies(spark):
    n = 20_000  # more than one piece of ids
    rows = spark.range(n).select(F.col("id").alias("conv_id"), F.array(*[F.struct(F.lit(k).cast("long").alias("id"), F.lit(2).alias("size")) for k in (4, 9)]).alias("turns"))
    deep = spark.range(3000).select(F.col("id"), (F.col("id") % 7).cast("int").alias("size"))
    long = deep.agg(F.sort_array(F.collect_list(F.struct("id", "size"))).alias("turns")).select(F.lit(n).cast("long").alias("conv_id"), "turns")
    for local in (100, 10**6):
        got = prefixes.trie(rows.unionByName(long), local).collect()
        by = {(r.conv_id, r.depth): r for r in got}
        assert len(got) == len(by) == 1 + 2 + 3000
        assert tuple(by[0, 0])[:7] == (0, 0, None, n + 1, 2, 2, (n - 1) * 4)
        assert by[0, 2].ends_sha256 == hashlib.sha256(",".join(map(str, range(n))).encode()).hexdigest()
        assert by[n, 3000].n_children == 0 and by[n, 1].parent_conv_id == 0 and by[n, 2].parent_conv_id == n


def test_real_conversations(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{Path(sf_dir)}/conversations.parquet'")
    assert found(prefixes.op13_prefixes(spark, sf_dir)) == sorted(con.sql(f"SELECT {', '.join(NAMES)} FROM ({prefixes.OP13_SQL})").fetchall(), key=repr)
