"""The pipeline's stages, one by one, against brute force on the smallest tables."""
import os

import duckdb
import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    import corpus_pipeline

    base = tmp_path_factory.mktemp("pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = {"input": docs.toPandas().set_index("doc_id")}
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{base}/{number}")
        docs = spark.read.parquet(f"{base}/{number}")
        out[name] = docs.toPandas()
        if "doc_id" in docs.columns and "text" in docs.columns:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            out[name] = out[name].set_index("doc_id")
    return out


def _sql(con, frame, sql):
    con.register("documents", frame.reset_index())
    return con.sql(sql).df().set_index("doc_id")


def test_quality_keeps_clean_documents(stages):
    labels = duckdb.sql(f"SELECT * FROM '{SF}/labels.parquet'").df().set_index("doc_id").quality
    kept = labels.index.isin(stages["quality classifier"].index)
    assert kept[labels == 1].mean() > 0.97 and kept[labels == 0].mean() < 0.1


def test_one_document_of_each_group_stays(stages):
    from pathweave.llm.queries import ORACLES

    want = _sql(duckdb.connect(), stages["quality classifier"], ORACLES["op7_near_duplicates"])
    assert set(stages["near-duplicates"].index) == set(want[want.kept].index)


def test_repeated_passages_are_cut(stages):
    from pathweave.llm.queries import ORACLES

    before, after = stages["near-duplicates"], stages["substring dedup"]
    want = _sql(duckdb.connect(), before, ORACLES["op1_substring_dedup"])
    assert set(after.index) == set(before.index)
    for doc, r in want.iterrows():
        assert len(after.text[doc].encode().split()) == r.n_words - r.n_removed
        assert after.n_chars[doc] == len(after.text[doc])
        if not r.n_removed:
            assert after.text[doc] == before.text[doc]


def test_benchmark_passages_go(stages):
    from pathweave.llm.queries import ORACLES

    con = duckdb.connect()
    con.sql(f"CREATE VIEW benchmark AS SELECT * FROM '{SF}/benchmark.parquet'")
    bad = set(_sql(con, stages["substring dedup"], ORACLES["op5_benchmark_decontamination"]).index)
    assert set(stages["benchmark decontamination"].index) == set(stages["substring dedup"].index) - bad


def test_packing_covers_what_is_left(stages):
    pieces = stages["packing"]
    assert set(pieces.doc_id) == set(stages["benchmark decontamination"].index)
    assert (pieces.groupby("doc_id").length.sum() == pieces.groupby("doc_id").doc_tokens.first()).all()
