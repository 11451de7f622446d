"""The registered query catalog: one DataFrame plan per SURVEY section 2 check.

Each entry takes ``(spark, sf_dir)`` and returns a DataFrame over the driver
tables (or views Spark derives from them).  Floats are rounded to 6 decimals
and counts cast to BIGINT so the DuckDB oracle can compare values exactly.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bleu as B
from ..operators import prepare as P
from ..session import spread
from ..sources import fixtures as FX
from ..sources.tables import table

PAIR_KEYS = ["conv_id", "turn"]
LINE_KEYS = list(FX.LINE_KEYS)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def r6(col):
    return F.round(col, 6)


def _pairs(spark, sf_dir) -> DataFrame:
    return P.prepare_pairs(FX.pairs_wide(spark, sf_dir), keep=PAIR_KEYS)


# --- prepare / BLEU ----------------------------------------------------------

@query
def prepare_pairs(spark, sf_dir):
    return _pairs(spark, sf_dir)


@query
def prepare_audit(spark, sf_dir):
    return P.prepare_audit(FX.pairs_wide(spark, sf_dir))


@query
def bleu_tokens(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    toks = B.tokenize_13a(F.col("text"))
    return docs.select("doc_id", F.size(toks).cast("bigint").alias("n_tokens"),
                       F.md5(F.array_join(toks, " ")).alias("tokens_md5"))


@query
def bleu_stats(spark, sf_dir):
    st = B.with_bleu_stats(_pairs(spark, sf_dir), "input", "target", out="s")
    return st.select(*PAIR_KEYS, "target_no", *[F.col("s." + f).alias(f) for f in B.STATS_FIELDS])


@query
def sentence_bleu(spark, sf_dir):
    pairs = B.with_sentence_bleu(_pairs(spark, sf_dir), "input", "target", out="b")
    return pairs.select(*PAIR_KEYS, "target_no", r6(F.col("b")).alias("bleu"),
                        r6(F.col("b") / F.lit(100.0)).alias("bleu_norm"))


@query
def corpus_bleu(spark, sf_dir):
    st = B.with_bleu_stats(_pairs(spark, sf_dir), "input", "target", out="s")
    agg = st.groupBy("target_no").agg(*B.sum_stats(F.col("s")), F.count(F.lit(1)).alias("n_pairs"))
    return agg.select("target_no", "n_pairs", *B.STATS_FIELDS, r6(B.corpus_bleu_expr()).alias("bleu"))


# --- scorers, candidates, rerank -------------------------------------------------

from ..functions import scorers as S  # noqa: E402
from ..operators import candidates as C  # noqa: E402
from ..operators import rerank as RR  # noqa: E402

# Objective weights (fixed values):
# J + 0.25 * BLEU_NORM + 0.1 * SIM + 0.2 * FL_PROB.
RERANK_WEIGHTS = {"J": 1.0, "BLEU_NORM": 0.25, "SIM": 0.1, "FL_PROB": 0.2}
SCORE_COLS = ["STA_PROB", "STA", "FL_PROB", "FL", "SIM", "BLEU", "BLEU_NORM", "J", "J_BINARY"]


def _samples(spark, sf_dir):
    return FX.rule_samples(spark, sf_dir)


def _scored(spark, sf_dir):
    return RR.rerank(_samples(spark, sf_dir), weights=RERANK_WEIGHTS, key=LINE_KEYS)


@query
def candidate_explode(spark, sf_dir):
    return C.candidates(_samples(spark, sf_dir), keep=LINE_KEYS)


@query
def toxicity_lexicon(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    ls = FX.line_samples(spark, sf_dir).join(labels, "doc_id", "left")
    p = S.toxicity_prob(F.col("source"))
    return ls.select(*LINE_KEYS, "toxic", S.lexicon_hits(F.col("source")).cast("bigint").alias("hits"),
                     r6(p).alias("p_toxic"), (p < F.lit(0.5)).cast("int").alias("non_toxic"))


@query
def fluency_features(spark, sf_dir):
    ls = FX.line_samples(spark, sf_dir)
    return ls.select(*LINE_KEYS, r6(S.fluency_prob(F.col("source"))).alias("fl_prob"),
                     S.fluency_label(F.col("source")).alias("fl_label"))


@query
def bow_cosine(spark, sf_dir):
    s = S.with_bow_cosine(_samples(spark, sf_dir), F.col("source"), F.col("reference"), out="sim")
    return s.select(*LINE_KEYS, r6(F.col("sim")).alias("sim"))


@query
def score_candidates(spark, sf_dir):
    scored, _ = _scored(spark, sf_dir)
    return scored.select(*LINE_KEYS, "model_idx", "candidate_rank",
                         *[r6(F.col(c)).alias(c) for c in SCORE_COLS])


@query
def objective_score(spark, sf_dir):
    scored, _ = _scored(spark, sf_dir)
    return scored.select(*LINE_KEYS, "model_idx", "candidate_rank", r6(F.col("objective")).alias("objective"))


@query
def rerank_top1(spark, sf_dir):
    _, best = _scored(spark, sf_dir)
    return best.select(*LINE_KEYS, "model_idx", "model", "candidate_rank", r6(F.col("objective")).alias("objective"))


@query
def rerank_all_candidates(spark, sf_dir):
    scored, _ = _scored(spark, sf_dir)
    out = RR.all_candidate_rows(scored, LINE_KEYS)
    return out.select(*[r6(F.col(c)).alias(c) if c in SCORE_COLS or c == "objective" else c
                        for c in out.columns])


@query
def rerank_selected(spark, sf_dir):
    _, best = _scored(spark, sf_dir)
    out = RR.selected_rows(best, key=LINE_KEYS)
    num = {"objective", "sta_prob", "sta", "sim", "fl_prob", "fl", "bleu", "j_prob"}
    return out.select(*[r6(F.col(c)).alias(c) if c in num else c for c in out.columns])


@query
def rerank_metrics(spark, sf_dir):
    _, best = _scored(spark, sf_dir)
    m = RR.corpus_metrics(best)
    return m.select(F.col("n").cast("bigint").alias("n"),
                    *[r6(F.col(c)).alias(c) for c in ("BLEU", "STA", "SIM", "FL", "J")])


from . import catalog_more  # noqa: E402,F401  (registers part 2)
