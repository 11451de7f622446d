"""Spark-native default scorers (UDF-01..04 offline backends), as expressions.

The reference scores text with neural classifiers that are not available
offline.  These defaults keep the same *interfaces* -- a toxicity probability,
an acceptability probability with its argmax label, a similarity in [-1, 1] --
and run inside the tasks, whose words are counted in Arrow batches:

* toxicity: ``p_toxic = 1 - exp(-k * lexicon_hits)``;
* fluency: a logistic of surface features (share of word-like tokens, length);
* similarity: cosine of bag-of-token count vectors (lower-cased tokens).

Neural or fitted backends plug in through ``operators.backends``.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.fixtures import LEXICON_RE, may_hold_lexicon
from .text import split_ws

# Own parameters of the offline default scorers (not reference values).
TOX_K = 1.0
# A "word-like" token: letters, optionally followed by closing punctuation.
WORD_RE = r"[A-Za-z]+[.,!?;:'\"]*"
#: Tokens that a task remembers at most.
WORDS_KEPT = 1 << 16
FL_SLOPE, FL_BIAS, FL_SHORT_PENALTY, FL_SHORT_TOKENS = 8.0, -4.0, 2.0, 3


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def lexicon_hits(col) -> Column:
    """Number of lexicon words in the text (case-insensitive, whole words)."""
    return F.when(may_hold_lexicon(_c(col)), F.regexp_count(_c(col), F.lit(LEXICON_RE))).otherwise(F.lit(0))


def toxicity_prob(col, k: float = TOX_K) -> Column:
    """Probability of the toxic class, in [0, 1)."""
    return F.lit(1.0) - F.exp(F.lit(-float(k)) * lexicon_hits(col).cast("double"))


def _word_counts(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """Tokens and word-like tokens of texts; NULL for NULL."""
    word_like = re.compile(WORD_RE).fullmatch

    class Known(dict):
        def __missing__(self, token):
            if len(self) >= WORDS_KEPT:
                self.clear()
            self[token] = found = word_like(token) is not None
            return found

    known = Known()
    for texts in batches:
        rows = []
        for text in texts.tolist():
            tokens = None if text is None else text.split()
            rows.append((None, None) if tokens is None else (len(tokens), sum(map(known.__getitem__, tokens))))
        yield pd.DataFrame(rows, columns=["n", "words"]).astype("Int32")


def fluency_logit(col) -> Column:
    counts = F.pandas_udf(_word_counts, "struct<n:int,words:int>")(_c(col).cast("string"))
    n, words = counts["n"], counts["words"]
    share = F.when(n > 0, words.cast("double") / n.cast("double")).otherwise(F.lit(0.0))
    short = F.when(n < FL_SHORT_TOKENS, F.lit(FL_SHORT_PENALTY)).otherwise(F.lit(0.0))
    return F.lit(FL_SLOPE) * share + F.lit(FL_BIAS) - short


def with_fluency(df: DataFrame, col, prob: str, label: str) -> DataFrame:
    """Add :func:`fluency_prob` and :func:`fluency_label`, the tokens counted once."""
    tmp = f"{prob}__logit"
    df = df.withColumn(tmp, fluency_logit(col))
    return df.withColumns({prob: F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col(tmp))), label: (F.col(tmp) > 0).cast("int")}).drop(tmp)


def fluency_prob(col) -> Column:
    """Acceptability probability (class 1 of a two-class softmax)."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-fluency_logit(col)))


def fluency_label(col) -> Column:
    """Argmax label of the two-class output: 1 iff p(accept) > p(reject)."""
    return (fluency_logit(col) > 0).cast("int")


def bow_tokens(col) -> Column:
    """Lower-cased whitespace tokens: the bag-of-token "embedding"."""
    return split_ws(F.lower(_c(col)))


def _cosine(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Cosine of the word counts of two lower-cased texts; the last ``b`` is counted once."""
    last, bag, square = None, Counter(), 0

    def one(a, b):
        nonlocal last, bag, square
        if b != last:
            last, bag = b, Counter(b.split())
            square = sum(n * n for n in bag.values())
        mine = bag if a == b else Counter(a.split())
        size = sum(n * n for n in mine.values()) * square
        dot = square if a == b else sum(n * bag[w] for w, n in mine.items() if w in bag)
        return dot / math.sqrt(size) if size else 0.0

    for left, right in batches:
        yield pd.Series([one(a, b) for a, b in zip(left.tolist(), right.tolist(), strict=True)], dtype="float64")


def with_bow_cosine(df: DataFrame, a, b, out: str = "sim") -> DataFrame:
    """Add ``out``: cosine of the token-count vectors of the texts ``a`` and ``b``.

    Exact, one hash pass a text; 0 when a side is NULL or has no tokens.  Where
    consecutive rows share ``b`` (the candidates of a sample) it is counted once.
    """
    texts = [F.coalesce(F.lower(_c(x).cast("string")), F.lit("")) for x in (a, b)]
    return df.withColumn(out, F.pandas_udf(_cosine, "double")(*texts))
