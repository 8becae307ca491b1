"""Stages on tables with columns that clash with inner names, with nulls, repeated rows and none."""

import pytest

import corpus_pipeline as P

NAMES = "fp rep component component_id key node a b u v size rank lane pos start block words uses taken _id n_words hit_words items n_lines n_dropped _gone _d _h docs first lang_pred score rejected draw share row shared target level LANG_PRED_X"


def table(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    extra = {n: f"'{n}'" for n in NAMES.split()}
    return df.selectExpr("*", *[f"{v} AS `{n}`" for n, v in extra.items()], "array(1, 2) AS `odd name`", "map('k', doc_id) AS m")


ROWS = [
    *[(i, f"the words of document number {i} are {'x' * i} and they say something of its own", "en", f"s{i % 3}", 10) for i in range(30)],
    *[(100 + i, "exactly the same text stands in all of these documents", "en", "s0", 1) for i in range(12)],
    (200, None, "en", "s1", None), (201, "", None, None, 0), (None, "no id but a text of some words", "en", "s1", 3), (5, "again the id five with another text", "en", "s2", 1), (202, "le la les " * 30_000, "fr", "s9", 1),
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("clash")
    spark.createDataFrame([("i1", "exactly the same text stands in all of these documents nowhere else"), (None, "x"), ("i2", None)], "item_id string, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


@pytest.mark.parametrize("k", range(5))
@pytest.mark.parametrize("rows", [ROWS, [], [(None, None, None, None, None)]])
def test_stage(spark, folder, k, rows):
    docs = table(spark, rows)
    out = P.STAGES[k][1](spark, docs, folder)
    found = out.collect()
    assert out.columns[: len(docs.columns)] == docs.columns and len(out.columns) == len(docs.columns) + (k == 4)
    assert len(found) <= len(rows)
    for r in found:
        assert r["score"] == "score" and r["odd name"] == [1, 2] and r["m"] == {"k": r["doc_id"]}
    if rows is ROWS and k not in (1, 4):
        texts = {t for _, t, *_ in ROWS}
        assert {r["text"] for r in found} <= texts
    if rows is ROWS and k == 2:
        assert sorted(r["doc_id"] for r in found if (r["doc_id"] or 0) >= 100) == [100, 200, 202]
        assert [r["text"] for r in found if r["doc_id"] is None] == ["no id but a text of some words"]
        assert any((r["text"] or "").startswith("again the id five") for r in found)


def test_line_dedup_by_join(spark, monkeypatch):
    from rillflow.llm import linededup

    docs = table(spark, ROWS)
    few, many = (sorted(linededup.drop_lines(docs, 10, most).select("doc_id", "text", "n_lines_", "n_dropped_").collect(), key=repr) for most in (0, 10**6))
    assert few == many
