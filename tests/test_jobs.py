"""End-to-end jobs, sink/source round trips and the Python generator backend."""
import json
import os

import pytest
from pyspark.sql import functions as F

from rewrite_lake.operators import candidates as C
from rewrite_lake.operators import runs as RU
from rewrite_lake.plans import jobs
from rewrite_lake.sources import files as IO

PAIRS = [
    ("you are a stupid idiot", "you are not smart", None, "you are wrong"),
    ("what a pathetic loser he is", "what a sad person he is", "he is sad", None),
    ("NA", "not available text", None, None),
    ("shut up you moron", "please be quiet", "be quiet", "quiet please"),
    ("abcd", "too short source", None, None),
]


@pytest.fixture
def pair_tsv(spark, tmpdir_path):
    df = spark.createDataFrame(PAIRS, "toxic string, neutral1 string, neutral2 string, neutral3 string")
    path = os.path.join(tmpdir_path, "pairs.tsv")
    IO.write_tsv(df, path, single_file=True)
    return path


def test_prepare_job_counts_and_split(spark, pair_tsv):
    pairs, audit = jobs.prepare_job(spark, pair_tsv, seed=7)
    a = audit.first()
    assert a["rows_in"] == 5 and a["sources_kept"] == 3 and a["pairs_out"] == 7   # "NA" -> NULL -> dropped
    sizes = {r["split"]: r["count"] for r in pairs.groupBy("split").count().collect()}
    assert sum(sizes.values()) == 7 and sizes.get("test") == 1 and sizes.get("validation") == 1


def test_rerank_job_writes_four_outputs(spark, pair_tsv, tmpdir_path):
    cfg = {"dataset_path": pair_tsv, "source_column": "toxic", "reference_column": "neutral1",
           "max_samples": 0, "models": [{"name": "identity"}, {"name": "mask"}, {"name": "drop"}],
           "scoring": {"toxicity_threshold": 0.5, "objective_weights": {"j": 1.0, "bleu_norm": 0.25}}}
    out_dir = os.path.join(tmpdir_path, "rerank")
    res = jobs.rerank_job(spark, cfg, output_dir=out_dir)
    sel = IO.read_tsv(spark, os.path.join(out_dir, "reranked_outputs.tsv"))
    assert sel.count() == 4 and len(sel.columns) == 14
    assert sorted(int(r["sample_id"]) for r in sel.collect()) == [0, 1, 2, 3]
    allc = IO.read_tsv(spark, os.path.join(out_dir, "all_candidates.tsv"))
    assert allc.count() == 12 and len(allc.columns) == 14
    m = spark.read.json(os.path.join(out_dir, "metrics.json")).first()
    assert set(m.asDict()) == {"BLEU", "STA", "SIM", "FL", "J"}
    assert m["J"] == pytest.approx(m["STA"] * m["SIM"] * m["FL"])
    cfg_back = json.loads(spark.read.json(os.path.join(out_dir, "config.used.json")).first()["config"])
    assert cfg_back["models"][1]["name"] == "mask"
    assert res["metrics"].first()["n"] == 4


def test_rerank_on_one_row(spark):
    one = spark.createDataFrame([(0, "you idiot", "you")], "sample_id bigint, source string, reference string")
    res = jobs.rerank_job(spark, {"models": [{"name": "identity"}, {"name": "drop"}]}, samples=one)
    assert res["selected"].first()["model_output"] == "you"


def test_metrics_text_round_trip(spark, tmpdir_path):
    df = spark.createDataFrame([("runA", 50.0, 0.9, 0.8, 0.7, 0.504), ("runB", 40.0, 0.8, 0.7, 0.6, 0.336)],
                               "run string, BLEU double, STA double, SIM double, FL double, J double")
    root = os.path.join(tmpdir_path, "metrics")
    IO.write_metrics_text(df, root, ["BLEU", "STA", "SIM", "FL", "J"], run="run")
    # one folder per run (run=runA/part-*.txt): rename-free read via the tree reader
    lines = spark.read.option("recursiveFileLookup", "true").text(root, wholetext=True).select(
        F.regexp_extract(F.col("_metadata.file_path"), r"run=([^/]+)", 1).alias("run"),
        F.posexplode(F.split("value", "\n")).alias("line_no", "line"))
    got = {r["Model"]: r["J"] for r in RU.run_summary(RU.parse_metric_lines(lines)).collect()}
    assert got == {"runA": 0.504, "runB": 0.336}


def test_python_generator_backend(spark):
    class Upper:
        def generate(self, prompts):
            return [[p.upper(), p.lower()] for p in prompts]

    s = spark.createDataFrame([(1, "Hello There"), (2, "Bye")], "sample_id bigint, source string")
    out = C.python_candidates(s, Upper, model_idx=3, model="upper", num_return=2).orderBy(
        "sample_id", "candidate_rank").collect()
    assert [(r["sample_id"], r["candidate_rank"], r["text"]) for r in out] == [
        (1, 0, "HELLO THERE"), (1, 1, "hello there"), (2, 0, "BYE"), (2, 1, "bye")]


def test_config_models_and_generation(spark, tmpdir_path):
    cfg = {"generation": {"num_beams": 6, "do_sample": False},
           "models": [{"name": "a", "path": "/m/a"}, {"path": "/m/b/", "generation": {"num_beams": 2}}]}
    path = os.path.join(tmpdir_path, "cfg.json")
    json.dump(cfg, open(path, "w"))
    loaded = IO.read_run_config(path, '{"max_samples": 5}')
    assert loaded["max_samples"] == 5
    models = IO.config_models(spark, loaded)
    eff = models.select("model_idx", "name", *RU.effective_generation(F.col("generation"), loaded["generation"]))
    eff = eff.orderBy("model_idx")
    rows = eff.collect()
    assert [r["name"] for r in rows] == ["a", "b"]
    assert [r["num_beams"] for r in rows] == [6, 2]
    assert all(r["top_p"] is None for r in rows)   # sampling-only keys dropped without do_sample


def test_bucketed_join_has_no_exchange(spark):
    from rewrite_lake.sources.files import write_bucketed
    docs = spark.range(0, 200).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    labels = spark.range(0, 200, 3).select(F.col("id").alias("doc_id"), (F.col("id") % 2).alias("toxic"))
    write_bucketed(docs, "t_docs_bkt", "doc_id", 4)
    write_bucketed(labels, "t_labels_bkt", "doc_id", 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        j = spark.table("t_docs_bkt").join(spark.table("t_labels_bkt"), "doc_id")
        plan = j._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and j.count() == 67
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("drop table if exists t_docs_bkt")
        spark.sql("drop table if exists t_labels_bkt")


def test_read_lines_and_require_columns(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "lines.txt")
    with open(path, "w") as f:
        f.write("  first line \n\n\tsecond \n   \nthird\n")
    got = [(r["line_no"], r["text"]) for r in IO.read_lines(spark, path).orderBy("line_no").collect()]
    assert got == [(0, "first line"), (2, "second"), (4, "third")]   # blank lines dropped, order kept
    df = spark.createDataFrame([("a", "b")], "toxic string, neutral1 string")
    assert IO.require_columns(df, ["toxic"], optional=["neutral1", "neutral2"]) == ["neutral2"]
    with pytest.raises(ValueError):
        IO.require_columns(df, ["model_output"])


def test_write_csv_round_trip(spark, tmpdir_path):
    df = spark.createDataFrame([("m1", 0.5), ("m2", None)], "Model string, J double")
    path = os.path.join(tmpdir_path, "summary.csv")
    IO.write_csv(df, path, single_file=True)
    back = spark.read.option("header", "true").csv(path).orderBy("Model").collect()
    assert [(r["Model"], r["J"]) for r in back] == [("m1", "0.5"), ("m2", None)]


def test_rerank_with_python_generator_candidates(spark):
    from rewrite_lake.operators import rerank as RR

    class Polite:
        def generate(self, prompts):
            return [["please " + p.replace("idiot", "friend"), p] for p in prompts]

    samples = spark.createDataFrame([(0, "you idiot go away", "you go away"), (1, "hello there", "hello there")],
                                    "sample_id bigint, source string, reference string")
    extra = C.python_candidates(samples, Polite, model_idx=1, model="polite", num_return=2)
    scored, best = RR.rerank(samples, models=["identity"], extra_candidates=extra)
    assert scored.count() == 2 * 3
    got = {r["sample_id"]: (r["model"], r["candidate_rank"]) for r in best.collect()}
    assert got[1] == ("identity", 0)          # tie with polite rank 1 -> config order wins (T10)
    assert got[0][0] == "polite"              # the non-toxic rewrite wins


def test_rerank_job_with_generator_backend(spark):
    class Echo:
        def generate(self, prompts):
            return [[p.replace("idiot", "friend"), p + "!"] for p in prompts]

    one = spark.createDataFrame([(0, "you idiot", "you friend")], "sample_id bigint, source string, reference string")
    cfg = {"generation": {"num_return_sequences": 2},
           "models": [{"name": "identity"}, {"name": "echo", "path": "/models/echo"}]}
    res = jobs.rerank_job(spark, cfg, samples=one, generators={"echo": Echo})
    allc = res["all_candidates"].orderBy("model", "candidate_rank").collect()
    assert [(r["model"], r["candidate_rank"]) for r in allc] == [("echo", 0), ("echo", 1), ("identity", 0)]
    assert res["selected"].first()["model_output"] == "you friend"
    with pytest.raises(ValueError):
        jobs.rerank_job(spark, {"models": [{"name": "unknown-model"}]}, samples=one)
