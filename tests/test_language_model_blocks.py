"""Texts meet the language model in packed trigrams: no join, whatever the blocks and the keys."""
import math
import random

import pytest

from rewrite_lake.operators import language_model as LM
from tests.test_models import kneser_ney


def test_scoring_joins_nothing(spark):
    texts = spark.createDataFrame([(1, "a b c"), (2, "a b")], "doc_id int, text string")
    plan = LM.score(LM.fit(texts), texts)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") <= 1


@pytest.mark.parametrize("blocks, chars", [(1, 1), (5, 40), (64, 1 << 24)])
def test_any_blocks_and_chunks_give_the_plain_model(spark, monkeypatch, blocks, chars):
    monkeypatch.setattr(LM, "BLOCKS", blocks)
    rng = random.Random(blocks)
    texts = [" ".join(rng.choice("the cat sat On a mat ran É ẞ".split()) for _ in range(rng.randint(0, 9))) for _ in range(50)] + [None]
    logp, _ = kneser_ney(texts)
    model = LM.fit(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3))
    new = [(None, "the cat"), (None, "sat zebra on"), (7, "the cat the cat the cat"), (7, ""), (8, None), (9, "\t ran ran ran")]
    got = {r["doc_id"]: (r["n_tokens"], r["logp"]) for r in LM.score(model, spark.createDataFrame(new, "doc_id int, text string")).collect()}
    want = {}
    for key, t in new:
        w = [" <", " <", *(t or "").lower().split(), " >"]
        want.setdefault(key, []).extend(logp(*g) for g in zip(w, w[1:], w[2:], strict=False))
    assert got.keys() == want.keys()
    for key, each in want.items():
        assert got[key][0] == len(each) - 1 and math.isclose(got[key][1], sum(each) / len(each), abs_tol=1e-9)
    rows = spark.createDataFrame(new, "doc_id int, text string").toArrow().to_batches()
    monkeypatch.setattr(LM, "CHUNK_CHARS", chars)
    parts = [t for _, t in LM._chunks(b.set_column(1, "text", b.column("text").fill_null("")) for b in rows)]
    assert sum(parts, []) == [t or "" for _, t in new] and (chars > 1 or max(map(len, parts)) <= 2)
