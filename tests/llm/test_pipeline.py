import corpus_pipeline as cp
from medlake.llm.common import read_table
from tests.llm.odd import base_rows, docs


def test_stages_and_run(spark, sf):
    assert [n for n, _ in cp.STAGES] == ["toxicity", "near_dedup", "decontaminate", "pii", "tokens"]
    source = read_table(spark, sf, "documents")
    now, columns = source, source.columns
    for name, stage in cp.STAGES:
        out = stage(spark, now, sf)
        assert out.columns[:len(columns)] == columns
        if name != "tokens":
            assert out.columns == columns and out.dtypes == source.dtypes
        assert out.count() <= now.count()
        now = out
    assert now.filter("not round_trip").count() == 0
    ids = sorted(r["doc_id"] for r in now.select("doc_id").collect())
    assert ids == sorted(r["doc_id"] for r in cp.run(spark, sf).select("doc_id").collect())


def test_stages_take_odd_rows(spark, sf):
    for rows in (base_rows(), []):
        now = docs(spark, rows, clash=False)
        for name, stage in cp.STAGES:
            now = stage(spark, now, sf)
        left = {r["doc_id"] for r in now.collect()}
        if rows:
            assert left == {1, 4, 5, 6, 7, 9, 10, 11, 13, None}
