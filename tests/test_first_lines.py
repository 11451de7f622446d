"""eval_preview (WIN-04): the first lines are taken before candidates, so no task sorts every candidate."""


def test_preview_takes_first_lines_before_candidates(spark, tmpdir_path):
    from rewrite_lake.plans.catalog import QUERIES
    docs = [(i, f"line {i} idiot\nsecond", "s", "en", 10) for i in range(20, 0, -1)]
    spark.createDataFrame(docs, "doc_id bigint, text string, source string, lang string, n_chars int").write.parquet(f"{tmpdir_path}/documents.parquet")
    out = QUERIES["eval_preview"](spark, tmpdir_path)
    assert "TakeOrderedAndProject" in out._jdf.queryExecution().executedPlan().toString()
    rows = out.collect()
    firsts = [(1, 0), (1, 1), (2, 0), (2, 1), (3, 0)]
    assert sorted((r["doc_id"], r["line_no"]) for r in rows if r["model"] == "drop") == firsts
    assert sorted((r["doc_id"], r["line_no"]) for r in rows if r["model"] == "half") == [(1, 0), (1, 0), (1, 1), (1, 1), (2, 0)]
