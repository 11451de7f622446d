"""Counts made in Arrow batches: equal to the Column definitions on odd texts and NULLs, in plans of bounded code."""
import re

import pytest
from pyspark.sql import functions as F

from rewrite_lake.functions import bleu as B
from rewrite_lake.functions import scorers as S
from rewrite_lake.functions import text as T
from rewrite_lake.operators import rewards as RW

ODD = ["", " ", "a b a b a", "x,y. 3.5, 4-5 -a- .,., ,.", "end-\nof line-\n", "-<skipped>\nb &amp;quot; &lt;p&gt;", " n b\x1cs déjà, vu!",
       "İI K ok. Ok", "a ,b . c", "(x)[y]{z} 1,000.50-2", "idiot you Moron", "two words", "one two three"]


def test_word_wise_13a_equals_the_column(spark):
    df = spark.createDataFrame([(x,) for x in [*ODD, *[a + b for a in ODD for b in ODD]]], "t string")
    rows = df.select("t", B.tokenize_13a("t").alias("w")).collect()
    words = B._Words()
    assert all(B.tokens_13a(r["t"], words) == r["w"] for r in rows)


def test_stats_and_score_of_nulls_and_repeats(spark):
    texts = [*ODD, None]
    df = spark.createDataFrame([(a, b) for b in texts for a in texts], "h string, r string")
    rows = B.with_bleu_stats(df, "h", "r", out="s").select("h", "r", "s.*", B.bleu_score(F.col("s"), True).alias("plain")).collect()
    assert all(r["score"] == pytest.approx(r["plain"], abs=1e-9) for r in rows)
    for r in rows:
        if (r["h"] is None) != (r["r"] is None):
            assert r["c1"] is None and r["score"] == 0.0
    (one,) = [r for r in rows if r["h"] == "a b a b a" and r["r"] == "a b a b a"]
    assert [one[f"c{n}"] for n in (1, 2, 3, 4)] == [5, 4, 3, 2]


def test_word_like_share_and_short_texts(spark):
    df = spark.createDataFrame([(x,) for x in [*ODD, None]], "t string")
    toks = T.split_ws("t")
    like = F.size(F.filter(toks, lambda t: t.rlike(r"^[A-Za-z]+[.,!?;:'\"]*$")))
    n = F.size(toks)
    share = F.when(n > 0, like / n).otherwise(0.0)
    logit = 8.0 * share - 4.0 - F.when(n < 3, 2.0).otherwise(0.0)
    got = S.with_fluency(df, "t", "p", "l").select("p", "l", (1 / (1 + F.exp(-logit))).alias("q"), (logit > 0).cast("int").alias("m"),
                                                   RW.trivial_output(F.lit("no"), F.col("t")).alias("short"), (n < 3).alias("few")).collect()
    assert all(r["p"] == pytest.approx(r["q"]) and r["l"] == r["m"] and r["short"] == r["few"] for r in got)


def test_generated_code_stays_small_enough_to_compile(spark):
    """A method of over 8,000 bytes is never compiled: it was 18,405 with the score as a Column."""
    samples = spark.createDataFrame([(1, "a b", "a")], "sample_id int, source string, reference string")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = RW.score_candidates(samples, ["sample_id"])._jdf.queryExecution().executedPlan()
        code = getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package").codegenString(plan)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert max(map(int, re.findall(r"maxMethodCodeSize:(\d+)", code))) < 8000
