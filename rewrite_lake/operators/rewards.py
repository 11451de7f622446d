"""Rewards and their batch statistics (RWD-01..04, WIN-02, AGG-08).

Per-row rewards are expressions; batch statistics are window aggregates
partitioned by batch (a bounded unit: ``batch_size`` rows).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import bleu as B
from ..functions import scorers as S
from ..functions.text import WS_CLASS, clip, empty_if_null, ustrip
from ..functions.vectors import cosine_to_unit
from . import rerank as RR
from .candidates import DEFAULT_MODELS, candidate_array

# Fixed values, needed for equal results: the z-score epsilon (added to the
# std) and clip, the weights and penalty of the base reward, and the tokens
# under which an output is trivial.
EPS = 1e-6
Z_CLIP = 2.5
REWARD_ALPHA, REWARD_BETA, TRIVIAL_PENALTY = 0.7, 0.3, 0.2
TRIVIAL_TOKENS = 3


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


# --- per-row rewards -------------------------------------------------------------

def trivial_output(prompt, output, min_len: int = TRIVIAL_TOKENS) -> Column:
    """Too short (< ``min_len`` tokens) OR a copy of the prompt after strip (FLT-06)."""
    long_enough = _c(output).rlike(rf"(?U)(?:[^\s\x{{1c}}-\x{{1f}}]++{WS_CLASS}*+){{{int(min_len)}}}")
    return ~long_enough | (ustrip(output) == ustrip(prompt))


def base_reward(tox, sim, trivial, alpha: float = REWARD_ALPHA, beta: float = REWARD_BETA) -> Column:
    """``clip(alpha*(1-tox) + beta*sim - 0.2*trivial, -1, 1)`` (RWD-01, T14)."""
    r = F.lit(alpha) * (F.lit(1.0) - _c(tox)) + F.lit(beta) * _c(sim)
    r = r - F.when(_c(trivial), F.lit(TRIVIAL_PENALTY)).otherwise(F.lit(0.0))
    return clip(r, -1.0, 1.0)


def with_mini_metrics(df: DataFrame, source: str, reference: str, output: str, cosine: str | None = None) -> DataFrame:
    """Per-row sta, sim in [0,1], fl, bleu in [0,1], j -- all clipped (RWD-02);
    ``cosine`` names a column to keep the raw cosine in."""
    out = F.col(output)
    df = df.withColumn("sta", clip(F.lit(1.0) - S.toxicity_prob(out), 0.0, 1.0))
    df = df.withColumn("fl", clip(S.fluency_prob(out), 0.0, 1.0))
    df = S.with_bow_cosine(df, F.col(source), out, out=cosine or "__cos")
    df = df.withColumn("sim", cosine_to_unit(F.col(cosine or "__cos"))).drop("__cos")
    df = B.with_sentence_bleu(df, empty_if_null(output), empty_if_null(reference), out="__bleu")
    df = df.withColumn("bleu", clip(F.col("__bleu") / F.lit(100.0), 0.0, 1.0)).drop("__bleu")
    return df.withColumn("j", clip(F.col("sta") * F.col("sim") * F.col("fl"), 0.0, 1.0))


def score_candidates(samples: DataFrame, keys: Sequence[str], models: Sequence[str] = DEFAULT_MODELS,
                     source: str = "source", reference: str = "reference") -> DataFrame:
    """The mini metrics and the base reward of every rule candidate (RWD-01, RWD-02).

    A sample's reference and source are tokenised once, its equal candidate texts
    scored once; the candidates are told apart again at the end.  Nothing is
    shuffled.  Output: ``*keys, model_idx, model, candidate_rank, source,
    reference, text, sta, sim, fl, bleu, j, cos, trivial, reward_raw``.
    """
    keys = list(keys)
    samples = samples.select(*keys, source, empty_if_null(reference).alias(reference))
    prepared = RR.prepare_samples(samples, source, reference)
    keep = [*keys, source, reference, RR.REF, RR.SRC_BOW]
    c = RR.distinct_texts(prepared.select(*keep, candidate_array(models, source).alias("__cands")), keep, "__cands")
    out = F.col("text")
    c = S.with_bow_cosine(c, out, RR.SRC_BOW, out="cos")
    c = B.with_bleu_stats(c, out, RR.REF, out="__stats")
    c = S.with_fluency(c, out, "__fl", "__label")
    c = c.select("*", clip(F.lit(1.0) - S.toxicity_prob(out), 0.0, 1.0).alias("sta"), clip("__fl", 0.0, 1.0).alias("fl"),
                 cosine_to_unit(F.col("cos")).alias("sim"),
                 clip(F.col("__stats")["score"] / F.lit(100.0), 0.0, 1.0).alias("bleu"),
                 trivial_output(F.col(source), out).alias("trivial"))
    c = c.withColumn("j", clip(F.col("sta") * F.col("sim") * F.col("fl"), 0.0, 1.0))
    # the second toxicity scorer is the same backend with another slope
    c = c.withColumn("reward_raw", base_reward(S.toxicity_prob(out, k=2.0), clip(F.col("cos"), -1.0, 1.0), F.col("trivial")))
    metrics = ["sta", "sim", "fl", "bleu", "j", "cos", "trivial", "reward_raw"]
    return c.select("*", F.inline("__members")).select(*keys, "model_idx", "model", "candidate_rank", source, reference, "text", *metrics)


# --- batch statistics ------------------------------------------------------------

def zscore(x, batch, clip_at: float = Z_CLIP) -> Column:
    """``clip((x - mean) / (std_pop + 1e-6), +-2.5)`` within a batch (WIN-02, T12)."""
    w = Window.partitionBy(*([batch] if isinstance(batch, (str, Column)) else batch))
    z = (_c(x) - F.avg(_c(x)).over(w)) / (F.stddev_pop(_c(x)).over(w) + F.lit(EPS))
    return clip(z, -clip_at, clip_at)


def stride_active(step, weight: float, stride: int) -> Column:
    """Metric gate: weight > 0 and the 1-based step divisible by stride (T15)."""
    stride = max(1, int(stride))
    return F.lit(weight > 0) & ((_c(step) % F.lit(stride)) == 0)


def blend(base, step, parts: Mapping[str, tuple[Column, float, int]]) -> Column:
    """``base * max(0, 1 - sum(active w)) + sum(active w * z)`` (RWD-04, T13).

    ``parts``: name -> (z-score column, weight, stride).  Weights are clipped to
    [0, 1] each; their sum is not (T13).  With no active part the base reward
    passes through unchanged.
    """
    total = F.lit(0.0)
    contrib = F.lit(0.0)
    for z, w, stride in parts.values():
        w = min(1.0, max(0.0, float(w)))
        on = stride_active(step, w, stride)
        total = total + F.when(on, F.lit(w)).otherwise(F.lit(0.0))
        contrib = contrib + F.when(on, F.lit(w) * z).otherwise(F.lit(0.0))
    return F.when(total > 0, _c(base) * F.greatest(F.lit(0.0), F.lit(1.0) - total) + contrib) \
            .otherwise(_c(base))
