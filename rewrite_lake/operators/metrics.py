"""Corpus metrics: BLEU, STA, SIM, FL, J in one aggregate (AGG-02..07, RPT-07).

``evaluate_pairs`` is one ``groupBy(by).agg(...)``: every metric is a sum or a
mean, so Spark runs a partial aggregate in each map task and shuffles one row
per group and task.  Corpus BLEU sums its 10 statistics; J is the product of
the three means (T2a), not a mean of products.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import bleu as B
from ..functions import scorers as S

METRIC_KEYS = ("BLEU", "STA", "SIM", "FL", "J")


def score_outputs(df: DataFrame, source: str, reference: str, output: str,
                  threshold: float = 0.5) -> DataFrame:
    """Per-row ingredients of the corpus metrics (toxicity, label, cosine, BLEU stats)."""
    out = F.col(output)
    df = df.withColumn("__p_toxic", S.toxicity_prob(out))
    df = df.withColumn("__non_toxic", (F.col("__p_toxic") < F.lit(threshold)).cast("int"))  # T1: strict
    df = df.withColumn("__fl", S.fluency_label(out))
    df = S.with_bow_cosine(df, F.col(source), out, out="__sim")
    return B.with_bleu_stats(df, out, F.col(reference), out="__bleu")


def evaluate_pairs(df: DataFrame, source: str = "toxic", reference: str = "neutral1",
                   output: str = "model_output", by: Sequence[str] = (),
                   threshold: float = 0.5) -> DataFrame:
    """The evaluator (RPT-07/AGG-06): NULL rows dropped first (FLT-01), then
    ``n, BLEU, STA, SIM, FL, J`` per group ``by`` (one row when empty)."""
    clean = df.na.drop(how="any", subset=[source, reference, output])
    scored = score_outputs(clean, source, reference, output, threshold)
    agg = scored.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        *B.sum_stats(F.col("__bleu")),
        F.avg(F.col("__non_toxic").cast("double")).alias("STA"),
        F.avg("__sim").alias("SIM"),
        F.avg(F.col("__fl").cast("double")).alias("FL"))
    return agg.select(*by, "n", B.corpus_bleu_expr().alias("BLEU"), "STA", "SIM", "FL",
                      (F.col("STA") * F.col("SIM") * F.col("FL")).alias("J"))


def eval_summary(df: DataFrame, by: Sequence[str] = (), toxicity: str = "toxicity",
                 similarity: str = "similarity", reward: str = "reward") -> DataFrame:
    """Evaluation summary (AGG-07): n, mean/population-std of toxicity and
    reward, mean similarity (numpy ``std`` is the population std)."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("samples"),
        F.avg(toxicity).alias("toxicity_mean"), F.stddev_pop(toxicity).alias("toxicity_std"),
        F.avg(similarity).alias("similarity_mean"),
        F.avg(reward).alias("reward_mean"), F.stddev_pop(reward).alias("reward_std"))
