"""Fixture views over the driver tables (FIXTURES.md section B).

The reference ships neither its pair dataset nor its models, so the tables its
operators consume are derived from the driver tables:

* ``pairs_wide``   -- (toxic, neutral1..3) pairs from user turns and later turns
* ``line_samples`` -- every line of every document, the rerank samples
* rule samples     -- line samples with a synthetic reference (candidates
                      are generated by ``operators.candidates``)
* ``runs``         -- (model, variant) metric rows from documents x labels
* ``vec_pairs``    -- consecutive embedding pairs

All are plain DataFrame plans: their work grows with the tables.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import split_ws
from ..session import spread
from .tables import table

# The ten-word English lexicon used by the rule rewriters and the
# lexicon toxicity scorer.
LEXICON = ("idiot", "moron", "stupid", "loser", "trash",
           "scum", "clown", "worthless", "pathetic", "disgusting")
LEXICON_RE = r"(?i)\b(" + "|".join(LEXICON) + r")\b"


def pairs_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turn as ``toxic``; the turns 1, 3 and 5 later as neutral1..3.

    ``neutral2`` is blanked for every third pair so absent targets occur.  Rows
    are keyed by (conv_id, turn).  The view is defined with ``lead()`` over each
    conversation; :func:`~rewrite_lake.operators.sampling.lead_in_blocks` computes
    it in blocks, so that a huge conversation is many tasks.
    """
    from ..operators.sampling import lead_in_blocks
    conv = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    t = lead_in_blocks(conv, "conv_id", "turn", "text", {1: "n1", 3: "n2", 5: "n3"})
    t = t.withColumn("pair_no", F.col("conv_id") + F.col("turn"))
    return t.where(F.col("role") == "user").select(
        "conv_id", "turn",
        F.col("text").alias("toxic"),
        F.col("n1").alias("neutral1"),
        F.when(F.col("pair_no") % 3 != 0, F.col("n2")).alias("neutral2"),
        F.col("n3").alias("neutral3"))


#: Key of a document line.
LINE_KEYS = ("doc_id", "line_no")


def line_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of every document, keyed by (doc_id, line_no): blank lines,
    short ones and all languages too."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", F.posexplode(F.split(F.col("text"), "\n", -1)).alias("line_no", "source"))


def may_hold_lexicon(col) -> F.Column:
    """Whether the letters of a lexicon word are in the text, whole word or not: a plain
    search, which spares most texts the pattern.  NULL for NULL."""
    return F.exists(F.array(F.lower(col)), lambda t: reduce(or_, [t.contains(w) for w in LEXICON]))


def _replace_lexicon(col, by: str) -> F.Column:
    return F.when(may_hold_lexicon(col), F.regexp_replace(col, LEXICON_RE, by)).otherwise(col)


def drop_lexicon(col) -> F.Column:
    """Rule rewrite: delete lexicon words."""
    return _replace_lexicon(col, "")


def mask_lexicon(col) -> F.Column:
    """Rule rewrite: replace lexicon words by ``***``."""
    return _replace_lexicon(col, "***")


def synthetic_reference(col) -> F.Column:
    """Reference of a line sample: the ``drop`` rewrite, space runs collapsed."""
    return F.regexp_replace(drop_lexicon(col), " +", " ")


def rule_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``line_samples`` as evaluation samples: (doc_id, line_no, source, reference)."""
    ls = line_samples(spark, sf_dir)
    return ls.select(*LINE_KEYS, "source", synthetic_reference(F.col("source")).alias("reference"))


def half_split(col):
    """First and second half of the whitespace tokens (first half rounds up)."""
    def halves(toks):
        n = F.size(toks)
        first = F.ceil(n / F.lit(2)).cast("int")
        return F.array(F.array_join(F.slice(toks, 1, first), " "), F.array_join(F.slice(toks, first + 1, n - first), " "))
    both = F.transform(F.array(split_ws(col)), halves)[0]  # the text is split once for a half
    return both[0], both[1]


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(model, variant) metric rows: source x language of labelled documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic", "quality")
    return docs.join(labels, "doc_id").groupBy(
        F.col("source").alias("model"), F.col("lang").alias("variant")).agg(
        F.avg((F.lit(1) - F.col("toxic")).cast("double")).alias("STA"),
        F.avg(F.col("quality").cast("double")).alias("FL"),
        F.count(F.lit(1)).alias("n"))


def vec_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each embedding with its successor (equi-join on vec_id + 1)."""
    emb = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    a = emb.alias("a")
    b = emb.alias("b")
    return a.join(b, F.col("b.vec_id") == F.col("a.vec_id") + 1).select(
        F.col("a.vec_id").alias("vec_id"), F.col("a.embedding").alias("va"),
        F.col("b.embedding").alias("vb"), F.col("a.label").alias("la"),
        F.col("b.label").alias("lb"))

