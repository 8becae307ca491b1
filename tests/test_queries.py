"""Every query of the survey against its SQL in DuckDB."""

import math
from pathlib import Path

import duckdb
import pytest

from rillflow.plans import displayed as _  # noqa: F401
from rillflow.plans import queries as Q
from rillflow.plans import terrain as _terrain  # noqa: F401

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{Path(sf_dir) / t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 9) if math.isfinite(v) else str(v)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


def rows_of(rows):
    return sorted((plain(tuple(r)) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_matches_sql(name, spark, sf_dir, duck):
    df = Q.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = rows_of(df.select(*[f"`{c}`" for c in columns]).collect())
    if name not in Q.SQL:
        assert got
        return
    rel = duck.sql(Q.SQL[name])
    assert sorted(rel.columns) == columns
    want = rows_of(duck.sql(f"SELECT {', '.join(f'"{c}"' for c in columns)} FROM ({Q.SQL[name]})").fetchall())
    assert got == want
