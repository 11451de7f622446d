"""Tables of fitted models are compressed files, not checkpoints of rows, and are made once."""
import os

import pytest

from rewrite_lake.operators import alignment as AL
from rewrite_lake.operators import embeddings as EM
from rewrite_lake.operators import language_model as LM
from rewrite_lake.session import ensure_checkpoint_dir


def _row_files(spark):
    home = ensure_checkpoint_dir(spark).removeprefix("file:")
    return {x for x in os.listdir(home) if x.startswith("rdd-")}


@pytest.mark.parametrize("fit", [lambda t, p: LM.fit(t), lambda t, p: EM.fit(t, dim=2), lambda t, p: AL.align_words(p).collect()])
def test_models_leave_no_checkpointed_rows(spark, fit):
    texts = spark.createDataFrame([("a b c d",), ("b c a d e",), (None,), ("",)], "text string")
    pairs = spark.createDataFrame([(1, "a b", "x y"), (2, "a", "x"), (3, None, "z"), (4, "b", None)], "pair_id int, input string, target string")
    before = _row_files(spark)
    fit(texts, pairs)
    assert _row_files(spark) == before


def test_repeated_trigrams_of_a_text_all_count(spark):
    texts = spark.createDataFrame([(1, "a b a b a b a b"), (2, "a b"), (3, None)], "doc_id int, text string")
    rows = {r["doc_id"]: r["n_tokens"] for r in LM.score(LM.fit(texts), texts).collect()}
    assert rows == {1: 8, 2: 2, 3: 0}
