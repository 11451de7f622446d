"""Semantic traps T1-T25 and properties, on hand-written tables."""
import math
import os

import pytest
from pyspark.sql import functions as F

from rewrite_lake.functions import bleu as B
from rewrite_lake.functions import text as T
from rewrite_lake.operators import candidates as C
from rewrite_lake.operators import prepare as P
from rewrite_lake.operators import rerank as RR
from rewrite_lake.operators import rewards as RW
from rewrite_lake.operators import runs as RU
from rewrite_lake.operators import sampling as SM
from rewrite_lake.sources import files as IO


def test_t8_unicode_strip_and_t9_empty_split(spark):
    df = spark.createDataFrame([("\t  hello  ",), ("",), ("   ",)], "x string")
    r = df.select(T.ustrip(F.col("x")).alias("s"), T.token_count(F.col("x")).alias("n")).collect()
    assert [x["s"] for x in r] == ["hello", "", ""]
    assert [x["n"] for x in r] == [1, 0, 0]


def test_t5_null_source_dropped_and_missing_targets(spark):
    df = spark.createDataFrame([(None, "a long target"), ("abcd", "a long target"),
                                ("abcde", "a long target"), ("valid text", None)], "toxic string, neutral1 string")
    out = P.prepare_pairs(df).collect()  # neutral2/3 columns do not exist (FLT-03)
    assert [(r["input"], r["target"]) for r in out] == [("abcde", "a long target")]


def test_t6_t7_tsv_round_trip_keeps_blank(spark, tmpdir_path):
    df = spark.createDataFrame([("a", " ", "NA"), ("b", "x", "null")], "k string, out string, z string")
    path = os.path.join(tmpdir_path, "t.tsv")
    IO.write_tsv(df, path, single_file=True)
    back = {r["k"]: r for r in IO.read_tsv(spark, path).collect()}
    assert back["a"]["out"] == " "          # a single space survives (T7)
    assert back["a"]["z"] is None and back["b"]["z"] is None  # pandas NA words (T6)


def test_t1_two_thresholds(spark):
    df = spark.createDataFrame([(0.5,), (0.49,), (0.51,)], "p double")
    r = df.select((F.col("p") < 0.5).alias("evaluator"),
                  ((1 - F.col("p")) >= (1 - 0.5)).alias("reranker")).collect()
    assert [(x["evaluator"], x["reranker"]) for x in r] == [(False, True), (True, True), (False, False)]


def _scored(spark, rows):
    return spark.createDataFrame(rows, "sample_id bigint, model_idx int, model string, candidate_rank int, "
                                       "text string, objective double")


def test_t10_t11_ties_and_nan(spark):
    rows = [(1, 1, "b", 0, "b0", 0.5), (1, 0, "a", 1, "a1", 0.5), (1, 0, "a", 2, "a2", 0.5),
            (2, 0, "a", 0, "nan", float("nan")), (2, 1, "b", 0, "ok", -3.0),
            (3, 0, "a", 0, "only-nan", float("nan")), (4, 0, "a", 0, "null", None), (4, 0, "a", 1, "x", 0.0)]
    best = {r["sample_id"]: r["text"] for r in RR.top1(_scored(spark, rows)).collect()}
    assert best == {1: "a1", 2: "ok", 3: "only-nan", 4: "x"}


def test_t20_unknown_metric_is_error():
    with pytest.raises(ValueError):
        RR.normalize_weights({"j": 1.0, "nope": 0.5})
    assert RR.normalize_weights({"j": 1, "bleu_norm": 0.25}) == {"J": 1.0, "BLEU_NORM": 0.25}


def test_t19_sample_without_candidates_is_skipped(spark):
    samples = spark.createDataFrame([(0, "you are an idiot", "you are"), (1, None, "ref")],
                                    "sample_id bigint, source string, reference string")
    _, best = RR.rerank(samples.where(F.col("source").isNotNull()))
    assert [r["sample_id"] for r in best.collect()] == [0]


def test_bleu_identity_and_short(spark):
    df = spark.createDataFrame([("a b c d e", "a b c d e"), ("one", "one"), ("", "x"), ("x y", "")],
                               "h string, r string")
    out = [r["b"] for r in B.with_sentence_bleu(df, F.col("h"), F.col("r"), out="b").collect()]
    assert out[0] == pytest.approx(100.0) and out[1] == pytest.approx(100.0)
    assert out[2] == 0.0 and out[3] == 0.0


def test_bleu_long_document_path(spark):
    words = " ".join(f"w{i % 97} v{i % 13}" for i in range(20000))
    df = spark.createDataFrame([(words, words)], "h string, r string")
    st = B.with_bleu_stats(df, F.col("h"), F.col("r"), out="s").first()["s"]
    n = 40000
    assert (st["c1"], st["c4"], st["hyp_len"]) == (n, n - 3, n)


def test_t13_t15_blend_weights_and_stride(spark):
    df = spark.createDataFrame([(1, 0.5, 1.0, 2.0), (2, 0.5, 1.0, 2.0)], "step int, base double, z1 double, z2 double")
    parts = {"m": (F.col("z1"), 0.8, 1), "b": (F.col("z2"), 0.4, 2)}
    r = {x["step"]: x["r"] for x in df.select("step", RW.blend(F.col("base"), F.col("step"), parts).alias("r")).collect()}
    assert r[1] == pytest.approx(0.5 * (1 - 0.8) + 0.8)           # stride 2 gates BLEU off on odd steps
    assert r[2] == pytest.approx(0.8 * 1.0 + 0.4 * 2.0)           # weights sum 1.2 -> base weight 0


def test_t14_penalty_once_and_clip(spark):
    df = spark.createDataFrame([("hello there friend", "hi"), ("same text here", "same text here")],
                               "prompt string, out string")
    r = df.select(RW.base_reward(F.lit(0.0), F.lit(1.0), RW.trivial_output(F.col("prompt"), F.col("out"))).alias("r"))
    assert [x["r"] for x in r.collect()] == pytest.approx([0.8, 0.8])  # 0.7 + 0.3 - 0.2


def test_t17_split_sizes_and_disjoint(spark):
    df = spark.range(0, 1001).withColumnRenamed("id", "k")
    s = SM.split_exact(df, 42, ["k"], buckets=16)
    sizes = {r["split"]: r["count"] for r in s.groupBy("split").count().collect()}
    assert (sizes["train"], sizes["validation"], sizes["test"]) == SM.split_sizes(1001)
    assert s.select("k").distinct().count() == 1001
    ranks = sorted(r["rank"] for r in s.select("rank").collect())
    assert ranks == list(range(1001))


def test_t18_sample_exact_raises(spark):
    df = spark.range(0, 10)
    with pytest.raises(ValueError):
        SM.sample_exact(df, 11, 1, ["id"])
    assert SM.sample_capped(df, 11, 1, ["id"]).count() == 10


def test_t21_rollup_rules(spark):
    lines = spark.createDataFrame([
        ("r1", 0, "Model: r1"), ("r1", 1, "----"), ("r1", 2, "BLEU: 1.23456"), ("r1", 3, "J: x"),
        ("r1", 4, "J: 0.5"), ("r1", 5, "J: 0.6"), ("r2", 0, "nothing here"), ("r3", 0, "STA: 0.9")],
        "run string, line_no int, line string")
    out = [r.asDict() for r in RU.run_summary(RU.parse_metric_lines(lines)).collect()]
    assert [o["Model"] for o in out] == ["r1", "r3"]        # J desc, NULL last; r2 has no metric
    assert out[0]["J"] == 0.6 and out[0]["BLEU"] == 1.2346


def test_batch_equals_stream(spark, tmpdir_path):
    from rewrite_lake.streaming.rerank_stream import rerank_stream
    samples = spark.createDataFrame(
        [(i, f"you are such an idiot number {i}", f"you are such an number {i}") for i in range(40)],
        "sample_id bigint, source string, reference string")
    inp = os.path.join(tmpdir_path, "in")
    samples.repartition(4).write.parquet(inp)
    q = rerank_stream(spark, inp, os.path.join(tmpdir_path, "out"), os.path.join(tmpdir_path, "ckpt"),
                      max_files_per_trigger=1)
    q.awaitTermination(300)
    streamed = spark.read.parquet(os.path.join(tmpdir_path, "out")).drop("batch_id")
    _, best = RR.rerank(samples)
    batch = RR.selected_rows(best)
    assert sorted(map(tuple, streamed.select(*batch.columns).collect())) == sorted(map(tuple, batch.collect()))


def test_candidates_follow_config_order(spark):
    s = spark.createDataFrame([(0, "a b c")], "sample_id bigint, source string")
    c = C.candidates(s, ["half", "identity"]).collect()
    assert [(r["model_idx"], r["model"], r["candidate_rank"], r["text"]) for r in c] == [
        (0, "half", 0, "a b"), (0, "half", 1, "c"), (1, "identity", 0, "a b c")]
    with pytest.raises(ValueError):
        C.candidates(s, [])


def test_softmax_argmax(spark):
    from rewrite_lake.functions import vectors as V
    df = V.with_softmax(spark.createDataFrame([([1.0, 3.0, 3.0],)], "x array<double>"), F.col("x"), "p")
    r = df.select("p", V.argmax(F.col("x")).alias("a")).first()
    assert r["a"] == 1 and sum(r["p"]) == pytest.approx(1.0)
    assert r["p"][1] == pytest.approx(math.exp(0) / (math.exp(-2) + 2))


def test_ml_toxicity_backend_auc(spark):
    from rewrite_lake.operators import backends as BK
    from rewrite_lake.sources.tables import table
    sf = "/root/testdata/sf0.01"
    if not os.path.isdir(sf):
        pytest.skip("test data absent")
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    lab = table(spark, sf, "labels").join(docs, "doc_id")
    train, test = lab.randomSplit([0.7, 0.3], seed=1)
    model = BK.fit_text_model(train)
    scored = BK.score_with_model(model, test)
    # whole documents with a few lexicon words among long prose: a weak but real signal
    assert BK.auc(scored, "p_toxic", "toxic") > 0.6


def test_batch_udf_equals_expression(spark):
    from rewrite_lake.functions import scorers as S
    from rewrite_lake.operators import backends as BK
    df = spark.createDataFrame([("you idiot, you moron",), ("hello",), ("",)], "t string")
    udf = BK.batch_scorer(BK.LexiconToxicity, batch_size=2)
    r = df.select(udf(F.col("t")).alias("u"), S.toxicity_prob(F.col("t")).alias("e")).collect()
    assert [x["u"] for x in r] == pytest.approx([x["e"] for x in r])


def test_forward_fill_blocks(spark):
    rows = [("f", i, (i // 10) if i % 10 == 0 and i < 45 else None) for i in range(100)]
    df = spark.createDataFrame(rows, "file string, line_no int, mark int")
    got = {r["line_no"]: r["e"] for r in RU.forward_fill(df, ["file"], "line_no", "mark", "e", block=7).collect()}
    want, cur = {}, None
    for _, i, m in rows:
        cur = m if m is not None else cur
        want[i] = cur
    assert got == want


def test_lead_in_blocks_equals_window(spark):
    from pyspark.sql import Window
    rows = [(0, t, f"a{t}") for t in range(0, 300, 3)] + [(1, t, f"b{t}") for t in (0, 5, 6)] + [(2, 0, "c0")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, text string")
    got = SM.lead_in_blocks(df, "conv_id", "turn", "text", {1: "n1", 3: "n3"}, block=16)
    w = Window.partitionBy("conv_id").orderBy("turn")
    want = df.select("conv_id", "turn", "text", F.lead("text", 1).over(w).alias("n1"),
                     F.lead("text", 3).over(w).alias("n3"))
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_lead_in_blocks_of_any_gaps_and_nulls(spark):
    from pyspark.sql import Window
    turns = [*range(0, 9000, 13), 4094, 4095, 50_000, 300_000, -70_000, None]
    rows = [(c, t, f"{c}-{t}" if t != 4095 else None) for c in (1, None) for t in turns] + [(2, None, "alone"), (3, 5, "one"), (3, None, "two")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, text string")
    w = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_last())
    names = {1: "n1", 3: "n3", 5: "n5"}
    want = df.select("*", *[F.lead("text", k).over(w).alias(n) for k, n in names.items()])
    for block in (4096, 16, 1):
        got = SM.lead_in_blocks(df, "conv_id", "turn", "text", names, block=block).select(*want.columns)
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    several = spark.createDataFrame([(1, None, f"v{i}") for i in range(50)] + [(1, 0, "x")], df.schema)
    got = SM.lead_in_blocks(several, "conv_id", "turn", "text", {1: "n1"}).collect()
    assert len(got) == 51 and {r["n1"] for r in got} == {None, *(f"v{i}" for i in range(50))}


def test_dense_ids_of_null_keys(spark):
    rows = [(0, 1), (0, None), (0, 70_000), (7000, 2), (None, 1), (None, None)]
    got = SM.dense_ids(spark.createDataFrame(rows, "a bigint, b bigint"), F.col("a"), F.col("b")).orderBy("row_id").collect()
    assert [(r["a"], r["b"], r["row_id"]) for r in got] == [(0, 1, 0), (0, 70_000, 1), (0, None, 2), (7000, 2, 3), (None, 1, 4), (None, None, 5)]


def test_dense_ids_across_blocks(spark):
    rows = [(a, b) for a in (0, 1, 5000, 9000) for b in range(0, 40, 3)]
    df = spark.createDataFrame(rows, "a bigint, b bigint")
    got = SM.dense_ids(df, F.col("a"), F.col("b"), span=4096, block=8).orderBy("a", "b").collect()
    assert [r["row_id"] for r in got] == list(range(len(rows)))
    empty = SM.dense_ids(df.limit(0), F.col("a"), F.col("b"))
    assert empty.count() == 0


def test_batch_cycle_steps(spark):
    df = spark.range(10).withColumnRenamed("id", "k")
    got = SM.batch_cycle(df, 4, 1, ["k"], steps=5).groupBy("step").count().orderBy("step").collect()
    assert [(r["step"], r["count"]) for r in got] == [(1, 4), (2, 4), (3, 2), (4, 4), (5, 4)]
    with pytest.raises(ValueError):
        SM.batch_cycle(df, 4, 1, ["k"])


def test_13a_whitespace_matches_python_split(spark):
    texts = ["a b", "a\x1cb c", "x y\tz", "  lead and trail 　", "tab\there", "", "ok."]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r["n"] for r in df.select(F.size(B.tokenize_13a(F.col("t"))).alias("n")).collect()]
    # Python's str.split() treats these code points as whitespace too
    want = [len((" " + t.rstrip().replace(".", " .") + " ").split()) for t in texts]
    assert got == want


def test_t12_population_vs_sample_std(spark):
    import statistics
    vals = [0.1, 0.4, 0.4, 0.9]
    df = spark.createDataFrame([(1, 1, v, 0.0) for v in vals], "batch_id int, step int, x double, v double")
    z = [r["z"] for r in df.select(RW.zscore(F.col("x"), "batch_id").alias("z")).collect()]
    mu, sd = statistics.fmean(vals), statistics.pstdev(vals)
    assert z == pytest.approx([max(-2.5, min(2.5, (x - mu) / (sd + 1e-6))) for x in vals])


def test_t3_three_sims(spark):
    from rewrite_lake.functions import vectors as V
    df = spark.createDataFrame([([1.0, 0.0], [-1.0, 0.0]), ([3.0, 4.0], [3.0, 4.0])], "a array<double>, b array<double>")
    r = df.select(V.cosine("a", "b").alias("raw"), V.cosine_to_unit(V.cosine("a", "b")).alias("unit"),
                  T.clip(V.cosine("a", "b"), -1.0, 1.0).alias("clipped")).collect()
    assert [x["raw"] for x in r] == pytest.approx([-1.0, 1.0])
    assert [x["unit"] for x in r] == pytest.approx([0.0, 1.0])
    assert [x["clipped"] for x in r] == pytest.approx([-1.0, 1.0])
