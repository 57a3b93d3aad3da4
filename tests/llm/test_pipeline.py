"""Stages of the corpus pipeline on small tables with nulls, repeats and further columns."""

import pytest

import corpus_pipeline as P

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, y int, _id long"
TOKEN = "AKIA" + "ABCDEFGHIJ012345"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, "plain words here", "en", "a"), (2, None, "en", "a"), (3, "", "en", None), (None, "more plain words", "en", "b"), (5, f"key {TOKEN} end", "en", "b"), (5, f"key {TOKEN} end", "en", "b"), (7, "word " * 3000, "en", "c")]
    return spark.createDataFrame([(*r, len(r[1] or ""), 999, 1, 5) for r in rows], SCHEMA)


def test_names():
    assert [n for n, _ in P.STAGES] == ["quality", "near_dedup", "decontaminate", "secrets", "mix"] and P.ORACLE_SQL is None


def test_secrets_are_masked_and_all_rows_stay(spark, docs):
    got = P.safe(spark, docs, "").collect()
    assert got[0].asDict().keys() == set(P.COLUMNS) and len(got) == 7
    assert sum(TOKEN in (r.text or "") for r in got) == 0 and sum(r.text == "key [SECRET] end" and r.n_chars == 16 for r in got) == 2
    assert P.safe(spark, docs.limit(0), "").collect() == []


def test_quality_ignores_clashing_columns(spark, docs, tmp_path):
    good = [(k, " ".join(f"clear{(k * 7 + j) % 50}" for j in range(40))) for k in range(100, 160)]
    bad = [(k, "#$ %% " * 20) for k in range(200, 260)]
    table = docs.unionByName(spark.createDataFrame([(i, t, "en", "a", len(t), 1, 0, 9) for i, t in good + bad], SCHEMA))
    spark.createDataFrame([(i, int(i < 200)) for i, _ in good + bad], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    got = {r.doc_id for r in P.good(spark, table, str(tmp_path)).collect()}
    assert len(got & {i for i, _ in good}) >= 55 and not got & {i for i, _ in bad}


def test_mix_keeps_columns_of_clashing_names(spark, docs):
    from annulus.llm import mixing

    got = mixing.mixed_documents(docs).collect()
    assert all(r["size"] == 999 and r.copies > 0 for r in got)
