"""Property test: Spark BLEU expressions == an independent Python restatement."""
import math
import re
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rewrite_lake.functions import bleu as B

_R = [(re.compile(r"([\{-\~\[-\` -\&\(-\+\:-\@\/])"), r" \1 "), (re.compile(r"([^0-9])([\.,])"), r"\1 \2 "),
      (re.compile(r"([\.,])([^0-9])"), r" \1 \2"), (re.compile(r"([0-9])(-)"), r"\1 \2 ")]


def tok(s):
    s = s.rstrip().replace("<skipped>", "").replace("-\n", "").replace("\n", " ")
    for a, b in (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        s = s.replace(a, b)
    s = f" {s} "
    for r, rep in _R:
        s = r.sub(rep, s)
    return s.split()


def stats(h, r):
    ht, rt = tok(h), tok(r)
    def grams(t):
        return Counter(tuple(t[i:i + n]) for n in range(1, 5) for i in range(len(t) - n + 1))
    hc, rc = grams(ht), grams(rt)
    correct = [0] * 4
    for g, k in hc.items():
        correct[len(g) - 1] += min(k, rc.get(g, 0))
    return correct, [max(len(ht) - n + 1, 0) for n in range(1, 5)], len(ht), len(rt)


def score(correct, total, hl, rl, effective):
    if not any(correct):
        return 0.0
    p, smooth, order = [0.0] * 4, 1.0, 4
    for n in range(4):
        if total[n] == 0:
            break
        if effective:
            order = n + 1
        if correct[n] == 0:
            smooth *= 2
            p[n] = 100.0 / (smooth * total[n])
        else:
            p[n] = 100.0 * correct[n] / total[n]
    bp = 1.0 if hl >= rl else (math.exp(1 - rl / hl) if hl > 0 else 0.0)
    logs = [math.log(x) if x > 0 else -9999999999 for x in p[:order]]
    return bp * math.exp(sum(logs) / order)


WORDS = st.sampled_from(["the", "a", "cat", "sat", "on", "mat", "3", "4-5", "1,000", "3.5", "end.", "(x)",
                         "&amp;", "&quot;hi&quot;", "don't", "well,", "-", "--", "e.g.", "a/b"])
TEXT = st.lists(WORDS, min_size=0, max_size=14).map(" ".join)


@settings(max_examples=3, deadline=None, derandomize=True)
@given(st.lists(st.tuples(TEXT, TEXT), min_size=60, max_size=60))
def test_sentence_and_corpus_bleu_match_python(spark, pairs):
    df = spark.createDataFrame(pairs, "h string, r string")
    st_df = B.with_bleu_stats(df, F.col("h"), F.col("r"), out="s")
    rows = st_df.select("h", "r", "s", B.bleu_score(F.col("s"), effective_order=True).alias("b")).collect()
    tot = [0] * 10
    for row in rows:
        c, t, hl, rl = stats(row["h"], row["r"])
        s = row["s"]
        assert [s[f"c{n}"] for n in range(1, 5)] == c and [s[f"t{n}"] for n in range(1, 5)] == t
        assert (s["hyp_len"], s["ref_len"]) == (hl, rl)
        assert abs(row["b"] - score(c, t, hl, rl, True)) < 1e-9
        for i, v in enumerate(c + t + [hl, rl]):
            tot[i] += v
    corpus = st_df.agg(*B.sum_stats(F.col("s"))).select(B.corpus_bleu_expr().alias("c")).first()["c"]
    assert abs(corpus - score(tot[:4], tot[4:8], tot[8], tot[9], False)) < 1e-9
