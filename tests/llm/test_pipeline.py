import corpus_pipeline as P
from rillflow.llm import common, decontam
from tests.llm.test_nearcopies import brute_kept


def test_stages_work_on_what_is_kept(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents")
    columns, before = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    assert [n for n, _ in P.STAGES] == ["language ID", "line dedup", "SimHash near-dedup", "benchmark decontamination", "mixing to target weights"]
    for k, (name, stage) in enumerate(P.STAGES):
        out, _ = common.materialize(stage(spark, docs, sf_dir), "t")
        now = {r.doc_id: r.text for r in out.collect()}
        assert out.count() == len(now) and set(now) <= set(before), name
        assert out.columns == columns + ["taken"] * (k == 4)
        if name == "SimHash near-dedup":
            assert sorted((False, d) for d in now) == brute_kept(list(before.items()), simhash_bits=3)
        if name == "benchmark decontamination":
            hit = {r.doc_id for r in decontam.digest(docs, common.table(spark, sf_dir, "benchmark")).where("contaminated").collect()}
            assert hit and set(now) == set(before) - hit
        docs, before = out, now

    assert {r.doc_id for r in P.run(spark, sf_dir).collect()} == set(before)
