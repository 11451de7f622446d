"""Learnt models of the pairs and texts against plain restatements."""
import itertools
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from rewrite_lake.functions import subwords as SW
from rewrite_lake.operators import alignment as AL
from rewrite_lake.operators import candidates as C
from rewrite_lake.operators import embeddings as EM
from rewrite_lake.operators import language_model as LM
from rewrite_lake.operators import rerank as RR
from rewrite_lake.operators import sampling as SM

# --- alignment -----------------------------------------------------------------------

PAIRS = [(1, "a", "you are stupid", "you are unwise"), (1, None, "stupid idea", "unwise idea"), (2, "a", "an idea", "an idea"),
         (None, "b", "stupid stupid you", "you unwise unwise"), (3, "c", None, "nothing"), (4, "d", "words", ""), (5, "e", "", "spoken")]


def em(pairs, rounds):
    p = {}
    for r in range(rounds):
        e = defaultdict(float)
        for *_, src, tgt in pairs:
            s, t = Counter(["", *(src or "").split()]), Counter((tgt or "").split())
            for y, ct in t.items():
                mass = {x: cs * (p[x, y] if r else 1.0) for x, cs in s.items()}
                for x in s:
                    e[x, y] += ct * mass[x] / sum(mass.values())
        total = defaultdict(float)
        for (x, _), v in e.items():
            total[x] += v
        p = {(x, y): v / total[x] for (x, y), v in e.items()}
    return p


@pytest.mark.parametrize("rounds", [1, 4])
def test_alignment_equals_plain_expectation_maximisation(spark, rounds):
    df = spark.createDataFrame(PAIRS, "x int, y string, input string, target string")
    got = {(r["s"], r["t"]): r["p"] for r in AL.align_words(df, ids=["x", "y"], rounds=rounds).collect()}
    want = em(PAIRS, rounds)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    assert AL.align_words(df.limit(0), ids=["x", "y"]).count() == 0


def test_k_best_equals_enumeration():
    rng = random.Random(2)
    for _ in range(300):
        options = [[0, *sorted(rng.choices([0, 1, 2, 5, 9], k=rng.randint(0, 3)))] for _ in range(rng.randint(0, 5))]
        every = []
        for way in itertools.product(*[range(len(o)) for o in options]):
            devs = tuple((i, o) for i, o in enumerate(way) if o)
            every.append((sum(o[w] for o, w in zip(options, way, strict=True)), len(devs), devs, list(way)))
        for k in (1, 3, 8):
            assert AL.k_best(options, k) == [e[-1] for e in sorted(every)[:k]]


def test_rewrites_are_candidates_of_the_rerank(spark):
    opts = spark.createDataFrame([("stupid", [(0, 5, "unwise"), (1, 7, "silly")]), ("you", [(0, 3, "you"), (1, 4, "we")])],
                                 "s string, options array<struct<rank:int,cost:bigint,target:string>>")
    rows = [(1, "a", "you are stupid", "you are unwise"), (1, None, "plain  words", "plain words"), (None, "b", "", ""), (2, "c", None, "x")]
    samples = spark.createDataFrame(rows, "k1 int, k2 string, source string, reference string")
    got = AL.rewrites(samples, opts, k=3, keys=["k1", "k2"]).collect()
    texts = {(r["k1"], r["k2"], r["candidate_rank"]): r["text"] for r in got}
    assert texts == {(1, "a", 0): "you are unwise", (1, "a", 1): "we are unwise", (1, "a", 2): "you are silly",
                     (1, None, 0): "plain words", (None, "b", 0): "", (2, "c", 0): ""}
    # one key that is no number
    extra = AL.rewrites(samples.where("k1 = 1 and k2 = 'a'").select(F.col("k2").alias("key"), "source"), opts, keys=["key"], model_idx=1)
    _, best = RR.rerank(samples.where("k2 = 'a'").select(F.col("k2").alias("key"), "source", "reference"), models=["identity"],
                        weights={"BLEU_NORM": 1.0}, extra_candidates=extra, key="key")
    assert [(r["model"], r["text"]) for r in best.collect()] == [("aligned", "you are unwise")]


def test_python_candidates_keep_any_key(spark):
    class Twice:
        def generate(self, prompts):
            return [[p + "!", p + "?"] for p in prompts]
    df = spark.createDataFrame([(1, "x", "hi"), (None, "y", None)], "a int, b string, source string")
    got = sorted(tuple(r) for r in C.python_candidates(df, Twice, 3, "m", 2, key=["a", "b"]).select("b", "a", "candidate_rank", "text", "model_idx").collect())
    assert got == [("x", 1, 0, "hi!", 3), ("x", 1, 1, "hi?", 3), ("y", None, 0, "!", 3), ("y", None, 1, "?", 3)]

# --- language model ----------------------------------------------------------------


def kneser_ney(texts):
    """log p(c | a b) of a plain modified Kneser-Ney model."""
    tri = Counter()
    for t in texts:
        w = [" <", " <", *(t or "").lower().split(), " >"]
        tri.update(zip(w, w[1:], w[2:], strict=False))
    bi, uni = Counter((b, c) for _, b, c in tri), Counter()
    uni.update(c for _, c in bi)

    def order(counts, context):
        n = [sum(v == i for v in counts.values()) for i in (1, 2, 3, 4)]
        d = LM.discounts(*n)
        cut = {g: min(v, d[min(v, 3) - 1]) for g, v in counts.items()}
        total, left = Counter(), Counter()
        for g, v in counts.items():
            total[context(g)] += v
            left[context(g)] += cut[g]
        return {g: (v - cut[g]) / total[context(g)] for g, v in counts.items()}, {x: left[x] / total[x] for x in total}
    p3, g3 = order(tri, lambda g: g[:2])
    p2, g2 = order(bi, lambda g: g[0])
    p1, g1 = order(uni, lambda g: None)
    rest = g1[None] / (len(uni) + 1)

    def logp(a, b, c):
        return math.log(p3.get((a, b, c), 0) + g3.get((a, b), 1) * (p2.get((b, c), 0) + g2.get(b, 1) * (p1.get(c, 0) + rest)))
    return logp, [*uni, "never met"]


def test_language_model_equals_a_plain_one_and_sums_to_one(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["the", "cat", "sat", "On", "a", "mat", "ran"])
                      for _ in range(rng.randint(0, 12))) for _ in range(60)] + [None, ""]
    model = LM.fit(spark.createDataFrame([(t,) for t in texts], "text string"))
    logp, vocabulary = kneser_ney(texts)
    new = ["the cat sat", "THE zebra sat on", "", None, "a a a a"]
    df = spark.createDataFrame([(i, None if i == 3 else "k", t) for i, t in enumerate(new)], "i int, k string, text string")
    got = {r["i"]: (r["n_tokens"], r["logp"]) for r in LM.score(model, df, keys=["i", "k"]).collect()}
    for i, t in enumerate(new):
        w = [" <", " <", *(t or "").lower().split(), " >"]
        want = [logp(*g) for g in zip(w, w[1:], w[2:], strict=False)]
        assert got[i][0] == len(want) - 1 and abs(got[i][1] - sum(want) / len(want)) < 1e-9
    for a, b in ((" <", " <"), ("the", "cat"), ("zebra", "the"), ("zebra", "zebra")):
        assert abs(sum(math.exp(logp(a, b, c)) for c in vocabulary) - 1) < 1e-9
    empty = LM.fit(spark.createDataFrame([], "text string"))
    assert LM.score(empty, df, keys=["i", "k"]).count() == 5

# --- embedding ----------------------------------------------------------------------


def test_cooccurrences_information_and_factors_equal_numpy(spark):
    rng = random.Random(6)
    texts = [" ".join(rng.choice("a B c d e f g h i j k l".split()) for _ in range(rng.randint(0, 15))) for _ in range(40)] + [None, "one"]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    want = Counter()
    for t in texts:
        w = (t or "").lower().split()
        for i in range(len(w)):
            for j in range(i + 1, min(len(w), i + 3)):
                want[w[i], w[j]] += 1
                want[w[j], w[i]] += 1
    counts = EM.cooccurrences(df, window=2)
    assert {(r["i"], r["j"]): r["n"] for r in counts.collect()} == dict(want)
    names = sorted({i for i, _ in want})
    total, each = sum(want.values()), Counter()
    for (i, _), n in want.items():
        each[i] += n
    m = np.zeros((len(names), len(names)))
    for (i, j), n in want.items():
        m[names.index(i), names.index(j)] = max(0.0, math.log(n * total / (each[i] * each[j])))
    info = EM.positive_information(counts)
    got = np.zeros_like(m)
    for r in info.collect():
        got[names.index(r["i"]), names.index(r["j"])] = r["v"]
    assert np.allclose(got, m)
    vectors, values = EM.factors(info, dim=len(names), rounds=3)
    assert np.allclose(np.sort(np.abs(values)), np.sort(np.linalg.svd(m, compute_uv=False)), atol=1e-8)
    v = np.array([r["vec"] for r in vectors.orderBy("word").collect()])
    assert np.allclose(v @ np.diag(values) @ v.T, m, atol=1e-7)


def test_similarity_equals_a_plain_average(spark):
    rng = random.Random(8)
    docs = [" ".join(rng.choice("red blue green dog cat bird runs flies sits".split()) for _ in range(10)) for _ in range(50)]
    model = EM.fit(spark.createDataFrame([(t,) for t in docs], "text string"), dim=4)
    vec = {r["word"]: np.array(r["vec"]) for r in model.vectors.collect()}

    def sentence(t):
        known = [vec[w] for w in (t or "").lower().split() if w in vec]
        v = np.mean(known, axis=0) if known else np.zeros(4)
        return v - (v @ model.common) * model.common
    rows = [(1, "dog runs", "Cat runs runs"), (2, "red", "red"), (None, "unknown words", "dog"), (4, None, "")]
    got = {r["id"]: r["sim"] for r in EM.similarity(model, spark.createDataFrame(rows, "id int, a string, b string"), "a", "b", ["id"]).collect()}
    for i, a, b in rows:
        x, y = sentence(a), sentence(b)
        size = np.linalg.norm(x) * np.linalg.norm(y)
        assert abs(got[i] - (x @ y / size if size else 0.0)) < 1e-9
    assert got[2] == pytest.approx(1.0)

# --- sub-words ---------------------------------------------------------------------


def naive_ends(piece, ranks):
    parts = [piece[i:i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], math.inf))
        if parts[best] + parts[best + 1] not in ranks:
            break
        parts[best:best + 2] = [parts[best] + parts[best + 1]]
    return list(itertools.accumulate(map(len, parts)))


def test_merging_equals_a_naive_loop_on_all_texts(spark):
    import regex
    import tiktoken
    path = SW.default_vocabulary()
    ranks = SW.load_ranks(path)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    pieces = {p for t in texts.values() for p in regex.findall(SW.PATTERN, t)} | {"x" * 300, "aab" * 50, "\U0001f600\U0001f600", "é" * 40}
    for p in pieces:
        assert SW.token_ends(p.encode(), ranks) == naive_ends(p.encode(), ranks), p
    library = tiktoken.Encoding("own", pat_str=SW.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in SW.truncate_subwords(docs, path).collect():
        ids = library.encode_ordinary(texts[r["doc_id"]])
        cut = library.decode_bytes(ids[:128]).decode("utf-8", "ignore")
        assert (r["truncated"]["text"], r["truncated"]["n_tokens"]) == (cut, min(128, len(ids)))


def test_odd_texts_are_cut(spark):
    path = SW.default_vocabulary()
    rows = [(1, None), (2, ""), (3, "z" * 200000 + " end"), (4, "\U0001f9ff" * 10), (5, "one two")]
    df = spark.createDataFrame(rows, "id int, text string")
    got = {r["id"]: tuple(r["truncated"]) for r in SW.truncate_subwords(df, path, max_tokens=5).collect()}
    assert got[1] == got[2] == ("", 0) and got[3][1] == 5 and got[3][0].strip("z") == "" and got[5] == ("one two", 2)
    assert got[4][1] == 5 and set(got[4][0]) <= {"\U0001f9ff"}
    assert SW.truncate_subwords(df, path, max_tokens=0).where("truncated.text <> ''").count() == 0

# --- samples of any size --------------------------------------------------------------


@pytest.mark.parametrize("n,buckets", [(0, 16), (1, 16), (57, 1), (57, 16), (57, 1 << 16), (200, 16), (500, 16)])
def test_samples_are_the_least_keys(spark, n, buckets):
    df = spark.createDataFrame([(i // 2, f"t{i % 3}") for i in range(200)], "id int, t string").repartition(5)
    keyed = df.withColumn("k", SM.random_key(9, ["id", "t"])).orderBy("k", "id", "t").limit(n).drop("k")
    got = SM.sample_capped(df, n, 9, ["id", "t"], buckets=buckets)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, keyed.collect()))
    if n == 57:  # rows pass no single task: only bucket counts do
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "TakeOrderedAndProject" not in plan and "GlobalLimit" not in plan
