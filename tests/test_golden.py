"""Files, formulas and reports against values worked out by hand."""
import math
import os

import pytest
from pyspark.sql import functions as F

from rewrite_lake.functions import bleu as B
from rewrite_lake.operators import candidates as C
from rewrite_lake.operators import rerank as RR
from rewrite_lake.operators import runs as RU
from rewrite_lake.plans import jobs
from rewrite_lake.plans.catalog_more import align
from rewrite_lake.sources import files as IO


def put(folder, name, text):
    path = os.path.join(folder, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", newline="") as f:
        f.write(text)
    return path


LOG = """loading
Epoch 1/2
  Step 01: reward=0.5 loss=1.0 kl=0.1
  Step 02: reward=1.5 loss=3.0 kl=0.3
  Eval reward=0.7 toxicity=0.2
Epoch 2/2
  Step 01: reward=2.0 loss=0.5 kl=0.2
ValueError: early_stopping is not understood: yes
"""


def test_sentence_bleu_by_hand(spark):
    rows = [("the cat sat on the mat", "the cat sat on a mat"), ("a b c d", "a b c d"), ("x", "y")]
    df = B.with_bleu_stats(spark.createDataFrame(rows, "h string, r string"), "h", "r", out="s")
    got = df.select("s.*", B.bleu_score(F.col("s"), True).alias("b")).collect()
    # 1-grams: the (1 of 2), cat, sat, on, mat = 5 of 6; 2: the cat, cat sat, sat on = 3 of 5; 3: 2 of 4; 4: 1 of 3
    assert [got[0][f"c{n}"] for n in (1, 2, 3, 4)] == [5, 3, 2, 1]
    assert [got[0][f"t{n}"] for n in (1, 2, 3, 4)] == [6, 5, 4, 3]
    assert got[0]["b"] == pytest.approx(100 * math.exp(sum(map(math.log, (5 / 6, 3 / 5, 2 / 4, 1 / 3))) / 4))
    assert got[1]["b"] == pytest.approx(100) and got[2]["b"] == 0


def test_objective_and_joint_formulas(spark):
    one = spark.createDataFrame([(0, "you idiot go home", "you go home")], "sample_id bigint, source string, reference string")
    scored, _ = RR.rerank(one, models=["drop"], weights={"J": 1, "BLEU_NORM": 0.25, "SIM": 0.1, "FL_PROB": 0.2})
    r = scored.first()
    assert r["J"] == pytest.approx(r["STA_PROB"] * r["SIM"] * r["FL_PROB"])
    assert r["objective"] == pytest.approx(r["J"] + 0.25 * r["BLEU"] / 100 + 0.1 * r["SIM"] + 0.2 * r["FL_PROB"])


def test_rollup_keeps_runs_of_one_name_apart(spark, tmpdir_path):
    put(tmpdir_path, "a/m1/metrics.txt", "Model: m1\r\nBLEU\t: 5\r\nJ: 0.5\r\n")
    put(tmpdir_path, "b/m1/metrics.txt", "J:\u00a00.9\nSTA: x\n")
    put(tmpdir_path, "b/m2/metrics.txt", "FL: 0.25\nnothing\n")
    got = [tuple(r) for r in jobs.rollup_job(spark, tmpdir_path).collect()]
    assert got == [("m1", None, None, None, None, 0.9), ("m1", 5.0, None, None, None, 0.5), ("m2", None, None, None, 0.25, None)]


def test_lines_of_many_splits_are_numbered(spark, tmpdir_path):
    path = put(tmpdir_path, "long.txt", "".join(f"line {i}\n" for i in range(4000)))
    put(tmpdir_path, "short.txt", "one\n\n two \n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = {(r["file"].rsplit("/", 1)[1], r["line_no"]): r["text"] for r in IO.read_lines(spark, tmpdir_path).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert path and len(got) == 4002
    assert all(got["long.txt", i] == f"line {i}" for i in range(4000))
    assert got["short.txt", 0] == "one" and got["short.txt", 2] == "two"


def test_trainer_state_and_best_checkpoint(spark, tmpdir_path):
    path = put(tmpdir_path, "state.json", '''{"best_global_step": 20, "best_metric": 0.5, "global_step": 30, "log_history": [
      {"epoch": 1.0, "step": 10, "loss": 2.0, "learning_rate": 0.1}, {"epoch": 1.0, "step": 10, "eval_loss": 0.8},
      {"epoch": 2.0, "step": 20, "eval_loss": 0.5}, {"epoch": 3.0, "step": 30, "eval_loss": 0.6}]}''')
    hist = IO.read_trainer_state(spark, path)
    assert hist.count() == 4 and hist.where(F.col("loss") == 2.0).count() == 1
    best = RU.best_checkpoint(hist).first()
    assert (best["best_step"], best["best_metric"], best["last_step"]) == (20, 0.5, 30)


def test_run_logs(spark, tmpdir_path):
    put(tmpdir_path, "full/m1_20250101_010203.log", LOG)
    put(tmpdir_path, "full/m2_20250101_010203.log", "Epoch 1/1\n  Step 01: reward=1 loss=1 kl=1\n")
    out = jobs.log_report_job(spark, tmpdir_path + "/full")
    hist = {(r["file"].rsplit("/", 1)[1][:2], r["epoch"]): r for r in out["history"].collect()}
    assert hist["m1", 1]["steps"] == 2 and hist["m1", 1]["reward_mean"] == 1.0 and hist["m1", 1]["kl_mean"] == pytest.approx(0.2)
    assert [hist["m1", e]["last_step"] for e in (1, 2)] == [2, 3]          # the global step
    assert [tuple(r) for r in out["failures"].collect()] == [("m1", "full", "ValueError: early_stopping is not understood: yes")]
    models = spark.createDataFrame([("m1",), ("m2",), ("m3",)], "model string")
    done = spark.createDataFrame([("m2", "full", 1234.5)], "model string, variant string, STA double")
    m = {r["model"]: (r["STA"], r["status"]) for r in RU.run_matrix(models, ["full"], done, ["STA"], failures=out["failures"]).collect()}
    assert m == {"m1": ("N/A", "ValueError: early_stopping is not understood: yes"), "m2": ("1234.5000", "ok"), "m3": ("N/A", "missing")}
    bare = spark.createDataFrame([("x.log", 0, "RuntimeError: no")], "file string, line_no int, line string")
    assert tuple(RU.log_failures(RU.parse_log_lines(bare)).first()) == ("x.log", "", "RuntimeError: no")


def test_ablation_leaves_incomplete_models_out(spark):
    rows = [("a", "full", 0.9), ("a", "no_x", 0.7), ("b", "full", 0.8)]
    df = spark.createDataFrame(rows, "model string, variant string, STA double")
    got = RU.ablation(df, ["full", "no_x"], "full", ["STA"]).collect()
    assert [(r["model"], r["variant"], round(r["delta_STA"], 6)) for r in got] == [("a", "no_x", -0.2)]


def test_registry_batch_sizes_names_and_overrides(spark):
    fam = spark.createDataFrame([("a", None, True), ("b", None, True), ("c", 16, True), ("d", 16, False)],
                                "model string, batch_size int, has_final_model boolean")
    hints = spark.createDataFrame([("a", 32), ("c", 4)], "model string, batch_hint int")
    got = {r["model"]: r for r in RU.registry([("rl", fam)], hints, generation={"rl": {"do_sample": True}}).collect()}
    assert {k: r["batch_size"] for k, r in got.items()} == {"a": 32, "b": None, "c": 4}
    assert got["a"]["name"] == "a-rl" and got["a"]["path"] == "models/rl/a" and got["a"]["generation"] == '{"do_sample": true}'


def test_generation_settings(spark):
    got = RU.generation_settings({"early_stopping": True}, {"length_penalty": 0.8, "num_beams": 2})
    assert got["early_stopping"] is True and got["length_penalty"] == 0.8 and got["num_beams"] == 2 and "top_p" not in got
    df = spark.createDataFrame([('{"early_stopping": true}',), ("{}",)], "g string")
    rows = df.select(*RU.effective_generation(F.col("g"), {"length_penalty": 0.8})).collect()
    assert [(r["early_stopping"], r["length_penalty"]) for r in rows] == [(True, 0.8), (None, 0.8)]


def test_generators_must_answer_in_full(spark):
    class Short:
        def generate(self, prompts):
            return [["a", "b", "c"] for _ in prompts][:-1]

    class Long:
        def generate(self, prompts):
            return [["a", "b", "c"] for _ in prompts]

    class Seen:
        def __init__(self, params):
            self.params = params

        def generate(self, prompts):
            return [[f"{p}|{self.params['num_beams']}"] for p in prompts]
    s = spark.createDataFrame([(1, "x"), (2, None)], "sample_id bigint, source string")
    for bad in (Short, Long):
        with pytest.raises(Exception, match="answers for|rewrites of"):
            C.python_candidates(s, bad, 0, "m", 2).collect()
    got = C.python_candidates(s, Seen, 0, "m", 1, params={"num_beams": 3}).orderBy("sample_id").collect()
    assert [r["text"] for r in got] == ["x|3", "|3"]          # a NULL source is not "None"


def test_alignment_counts_what_is_missing(spark):
    inputs = spark.createDataFrame([(1,), (2,)], "k bigint")
    preds = spark.createDataFrame([(1, "a")], "k bigint, out string")
    assert sorted((r["k"], r["matched"]) for r in align(inputs, preds, ["k"]).collect()) == [(1, True), (2, False)]
    with pytest.raises(ValueError, match="1 inputs have no prediction"):
        jobs.checked_align(inputs, preds, ["k"])
    assert jobs.checked_align(inputs.where("k = 1"), preds, ["k"]).count() == 1


def test_composite_keys_survive_long_documents(spark):
    rows = [(0, 100_000, "one two three", "one two three"), (1, 0, "four five six", "four five six")]
    s = spark.createDataFrame(rows, "doc_id bigint, line_no int, source string, reference string")
    scored, best = RR.rerank(s, models=["identity"], key=["doc_id", "line_no"])
    assert scored.count() == 2 and best.count() == 2


def test_empty_rerank_writes_nothing(spark, tmpdir_path):
    none = spark.createDataFrame([], "sample_id bigint, source string, reference string")
    out = os.path.join(tmpdir_path, "none")
    jobs.rerank_job(spark, {"models": [{"name": "identity"}]}, samples=none, output_dir=out)
    assert not os.path.exists(out)


def test_missing_reference_falls_back_to_source(spark):
    df = spark.createDataFrame([(0, "src", None), (1, None, "ref"), (2, "s", "r")], "row_id bigint, toxic string, neutral1 string")
    got = jobs.select_samples(df, "toxic", "neutral1", None).orderBy("sample_id").collect()
    assert [(r["sample_id"], r["source"], r["reference"]) for r in got] == [(0, "src", "src"), (1, "s", "r")]


def test_evaluate_job(spark, tmpdir_path):
    df = spark.createDataFrame([("you idiot go", "you go", "you go"), ("a b c d", "a b c d", "a b c d")],
                               "toxic string, neutral1 string, model_output string")
    path = os.path.join(tmpdir_path, "pred.tsv")
    IO.write_tsv(df, path)
    r = jobs.evaluate_job(spark, path).first()
    assert r["n"] == 2 and r["STA"] == 1.0 and r["BLEU"] == pytest.approx(100.0)
    assert r["SIM"] == pytest.approx((2 / math.sqrt(6) + 1) / 2) and r["J"] == pytest.approx(r["STA"] * r["SIM"] * r["FL"])


def test_checkpoint_dir_must_be_named_on_a_cluster():
    from types import SimpleNamespace as NS

    from rewrite_lake.session import ensure_checkpoint_dir
    unset = NS(isDefined=lambda: False)
    sc = NS(master="spark://host:7077", _jsc=NS(sc=lambda: NS(getCheckpointDir=lambda: unset)))
    with pytest.raises(ValueError, match="all executors"):
        ensure_checkpoint_dir(NS(sparkContext=sc, conf=NS(get=lambda *a: None)))


def test_hashed_similarity_and_fitted_models(spark):
    from rewrite_lake.operators import backends as BK
    df = spark.createDataFrame([("a b", "a b"), ("a b", "a c"), ("a", "z"), ("", "x"), (None, "x")], "a string, b string")
    got = [r["sim"] for r in BK.with_hashed_cosine(df, "a", "b").collect()]
    assert got == pytest.approx([1.0, 0.5, 0.0, 0.0, 0.0])
    docs = spark.createDataFrame([(i, "fine words here" if i % 2 else "utter trash talk") for i in range(40)], "doc_id bigint, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    train = BK.labelled_sample(docs, labels, "quality", rows=20)
    assert train.count() == 20
    scored = BK.score_with_model(BK.fit_text_model(train, label="quality"), docs, out="p")
    assert scored.where((F.col("p") > 0.5) != (F.col("doc_id") % 2 == 1)).count() == 0


def test_building_a_query_starts_no_jobs_but_schema_reads(spark):
    """What a query does, it does when it runs; fitted models are trained when built."""
    from rewrite_lake.plans.catalog import QUERIES
    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("test data absent")
    tracker = spark.sparkContext.statusTracker()
    for name, fn in QUERIES.items():
        if name.endswith("_fitted"):
            continue
        spark.sparkContext.setJobGroup(f"build-{name}", name)
        fn(spark, sf)
        for job in tracker.getJobIdsForGroup(f"build-{name}"):
            info = tracker.getJobInfo(job)
            tasks = sum(tracker.getStageInfo(s).numTasks for s in info.stageIds)
            assert len(info.stageIds) == 1 and tasks == 1, name   # a parquet footer read
    spark.sparkContext.setJobGroup("", "")


def test_summary_column_order(spark):
    lines = spark.createDataFrame([("r", 0, "J: 0.5")], "run string, line_no int, line string")
    assert RU.run_summary(RU.parse_metric_lines(lines)).columns == ["Model", "BLEU", "STA", "SIM", "FL", "J"]
