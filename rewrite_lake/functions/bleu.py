"""BLEU from its published definition (Papineni et al. 2002; Post 2018), as
Spark Column expressions (BLEU-01..05).

* ``tokenize_13a``: the "13a" tokenizer of the WMT mteval script.
* ``bleu_stats``: per row, clipped n-gram matches ``correct[1..4]``, n-gram
  totals ``total[1..4]`` and the two lengths -- 10 additive numbers.
* ``bleu_score``: score from the statistics with exponential smoothing; sentence
  mode uses the *effective order* (stop at the first order with no n-grams),
  corpus mode always uses order 4.
* ``corpus_bleu``: sum the statistics (a partial + final aggregate, so it merges
  across partitions and groups) and score once.

Scale: the statistics of a row are counted in Arrow batches inside the tasks, one
hash pass per order; consecutive rows with one reference (the candidates of a
sample) count its n-grams once.  Nothing is shuffled and no state outlives a batch
but the last reference.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import split_ws, urstrip

MAX_ORDER = 4
#: Words whose tokens a task keeps at most.
WORDS_KEPT = 1 << 16

# Fixed values of the 13a tokenizer (must equal the mteval-v13a rules):
# entity unescapes, in this order, then the four regex rewrites, in this order.
_UNESCAPES = (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"))
_REWRITES = (
    (r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", " $1 "),
    (r"([^0-9])([\.,])", "$1 $2 "),
    (r"([\.,])([^0-9])", " $1 $2"),
    (r"([0-9])(-)", "$1 $2 "),
)

STATS_FIELDS = ["c1", "c2", "c3", "c4", "t1", "t2", "t3", "t4", "hyp_len", "ref_len"]


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _lit_replace(col: Column, search: str, repl: str) -> Column:
    return F.replace(col, F.lit(search), F.lit(repl))


def tokenize_13a(col) -> Column:
    """13a tokens of a string column (case kept), ``array<string>``."""
    s = urstrip(_c(col))
    s = _lit_replace(s, "<skipped>", "")
    s = _lit_replace(s, "-\n", "")
    s = _lit_replace(s, "\n", " ")
    for search, repl in _UNESCAPES:
        s = _lit_replace(s, search, repl)
    s = F.concat(F.lit(" "), s, F.lit(" "))
    for pattern, repl in _REWRITES:
        s = F.regexp_replace(s, pattern, repl)
    return split_ws(s)


_PY_REWRITES = [(re.compile(pattern), repl.replace("$", "\\")) for pattern, repl in _REWRITES]


class _Words(dict):
    """The 13a tokens of a whitespace-separated word, kept for the words met lately."""

    def __missing__(self, word: str) -> tuple[str, ...]:
        if len(self) >= WORDS_KEPT:
            self.clear()
        self[word] = found = self._tokens(word)
        return found

    @staticmethod
    def _tokens(word: str) -> tuple[str, ...]:
        if word.isalnum():  # no rule looks at letters and digits alone
            return (word,)
        if word[-1] in ".," and word[:-1].isalnum():
            return word[:-1], word[-1]
        text = word
        for search, repl in _UNESCAPES:
            text = text.replace(search, repl)
        text = f" {text} "
        for pattern, repl in _PY_REWRITES:
            text = pattern.sub(repl, text)
        return tuple(text.split())


def tokens_13a(text: str, words: _Words | None = None) -> list[str]:
    """:func:`tokenize_13a` of one Python string.  No rule looks past the whitespace
    around a word but the one of hyphens at line ends, which goes first."""
    words = _Words() if words is None else words
    text = text.rstrip().replace("<skipped>", "").replace("-\n", "")
    return list(chain.from_iterable(map(words.__getitem__, text.split())))


def _grams(tokens: list[str], n: int) -> Iterator:
    return iter(tokens) if n == 1 else zip(*(tokens[i:] for i in range(n)), strict=False)


class _Reference:
    """A text's tokens and, by order, its different n-grams, made when first asked for."""

    def __init__(self, tokens: list[str]):
        self.tokens, self._different = tokens, {}

    def different(self, n: int) -> set:
        if n not in self._different:
            self._different[n] = set(_grams(self.tokens, n))
        return self._different[n]


def _matches(hyp: list[str], ref: _Reference, n: int) -> int:
    """``sum(min(count, count))`` of the n-grams; where either side has no repeats every minimum is 0 or 1."""
    mine, theirs = set(_grams(hyp, n)), ref.different(n)
    shared = mine & theirs
    if len(mine) == len(hyp) - n + 1 or len(theirs) == len(ref.tokens) - n + 1 or not shared:
        return len(shared)
    counts = (Counter(g for g in _grams(t, n) if g in shared) for t in (hyp, ref.tokens))
    return (next(counts) & next(counts)).total()


def _run_at_an_end(hyp: list[str], ref: list[str]) -> bool:
    """Whether the reference begins or ends with the hypothesis: then each of its n-grams is matched in full."""
    return ref[:len(hyp)] == hyp or ref[-len(hyp):] == hyp


def _sentence_score(c: list, t: list, hyp_len, ref_len) -> float:
    """:func:`bleu_score` with effective order, of plain numbers."""
    if c[0] is None or not any(c):
        return 0.0
    logs, zeros, order = 0.0, 0, 0
    for matched, total in zip(c, t, strict=True):
        if total > 0:
            order += 1
            zeros += matched == 0
            logs += math.log(100.0 * matched / total if matched else 100.0 / (2.0 ** zeros * total))
    return (1.0 if hyp_len >= ref_len else math.exp(1.0 - ref_len / hyp_len)) * math.exp(logs / order)


_STATS_TYPE = "struct<" + ",".join(f"{f}:bigint" for f in STATS_FIELDS) + ",score:double>"


def _stats(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    words, last, kept = _Words(), None, _Reference([])

    def row(hyp, ref):
        nonlocal last, kept
        if ref is not None and ref != last:
            last, kept = ref, _Reference(tokens_13a(ref, words))
        tokens = [] if hyp is None else kept.tokens if hyp == ref else tokens_13a(hyp, words)
        size = len(tokens)
        totals = [max(size - n, 0) for n in range(MAX_ORDER)]
        hyp_len, ref_len = (None if hyp is None else size), (None if ref is None else len(kept.tokens))
        if hyp == ref:
            return (*totals, *totals, hyp_len, ref_len)
        if hyp is None or ref is None:
            return (*[None] * MAX_ORDER, *totals, hyp_len, ref_len)
        if size and _run_at_an_end(tokens, kept.tokens):
            return (*totals, *totals, hyp_len, ref_len)
        correct = []
        for n in range(1, MAX_ORDER + 1):  # an n-gram that matches holds a shorter one that does
            correct.append(_matches(tokens, kept, n) if n == 1 or correct[-1] else 0)
        return (*correct, *totals, hyp_len, ref_len)

    for hyps, refs in batches:
        rows = [row(h, r) for h, r in zip(hyps.tolist(), refs.tolist(), strict=True)]
        out = pd.DataFrame(rows, columns=STATS_FIELDS).astype("Int64")
        out["score"] = pd.Series([_sentence_score(r[:4], r[4:8], r[8], r[9]) for r in rows], dtype="float64")
        yield out


def with_bleu_stats(df: DataFrame, hyp, ref, out: str = "bleu_stats") -> DataFrame:
    """Add ``out``: the 10 sufficient statistics of BLEU per row, and the sentence's
    ``score`` (BLEU-04, effective order), as a struct.

    ``hyp`` and ``ref`` are string columns (13a-tokenized here).  The clipped matches
    of an order are ``sum(min(count, count))``; a hypothesis that the reference begins
    or ends with (cut off, or equal) matches in full.  Without a hypothesis or a reference the matches are NULL.
    """
    return df.withColumn(out, F.pandas_udf(_stats, _STATS_TYPE)(_c(hyp).cast("string"), _c(ref).cast("string")))


def bleu_score(stats: Column, effective_order: bool) -> Column:
    """BLEU (0-100) from a statistics struct; exponential smoothing.

    Walk n = 1..4 and stop at the first order with no n-grams.  An order
    with no match is smoothed as 100 / (2^k * total) where k counts the
    zero-match orders so far.  Sentence mode divides by the orders reached;
    corpus mode by 4, and an unreached order then makes the score 0.
    """
    c = [stats[f"c{n}"].cast("double") for n in range(1, MAX_ORDER + 1)]
    t = [stats[f"t{n}"].cast("double") for n in range(1, MAX_ORDER + 1)]
    hyp_len = stats["hyp_len"].cast("double")
    ref_len = stats["ref_len"].cast("double")

    log_terms = []
    zeros_so_far = F.lit(0.0)
    for n in range(MAX_ORDER):
        reached = t[n] > 0
        zeros_so_far = zeros_so_far + F.when(reached & (c[n] == 0), F.lit(1.0)).otherwise(F.lit(0.0))
        p = F.when(c[n] == 0, F.lit(100.0) / (F.pow(F.lit(2.0), zeros_so_far) * t[n])) \
             .otherwise(F.lit(100.0) * c[n] / t[n])
        log_terms.append(F.when(reached, F.log(p)).otherwise(F.lit(0.0)))
    log_sum = log_terms[0]
    for term in log_terms[1:]:
        log_sum = log_sum + term

    reached_orders = sum(F.when(t[n] > 0, F.lit(1)).otherwise(F.lit(0)) for n in range(MAX_ORDER))
    order = reached_orders.cast("double") if effective_order else F.lit(float(MAX_ORDER))
    bp = F.when(hyp_len < ref_len,
                F.when(hyp_len > 0, F.exp(F.lit(1.0) - ref_len / hyp_len)).otherwise(F.lit(0.0))) \
          .otherwise(F.lit(1.0))
    any_match = (c[0] + c[1] + c[2] + c[3]) > 0
    complete = (reached_orders > 0) if effective_order else (t[MAX_ORDER - 1] > 0)
    return F.when(any_match & complete, bp * F.exp(log_sum / order)).otherwise(F.lit(0.0))


def with_sentence_bleu(df: DataFrame, hyp, ref, out: str = "bleu") -> DataFrame:
    """Add sentence BLEU with effective order (0-100), BLEU-04."""
    tmp = f"{out}__stats"
    df = with_bleu_stats(df, hyp, ref, out=tmp)
    return df.withColumn(out, F.col(tmp)["score"]).drop(tmp)


def sum_stats(stats: Column) -> list[Column]:
    """Aggregate expressions that add up BLEU statistics (partial + final)."""
    return [F.sum(stats[f]).alias(f) for f in STATS_FIELDS]


def stats_struct(prefix: str = "") -> Column:
    """Re-pack summed statistic columns into a struct for ``bleu_score``."""
    return F.struct(*[F.col(prefix + f).alias(f) for f in STATS_FIELDS])


def corpus_bleu_expr(prefix: str = "") -> Column:
    """Corpus BLEU over already-summed statistic columns, BLEU-05."""
    return bleu_score(stats_struct(prefix), effective_order=False)
