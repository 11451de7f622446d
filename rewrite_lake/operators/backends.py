"""Model backends: the UDF surface (UDF-01..06).

The reference's extension points are batch functions ``list[str] -> list[x]``
(toxicity, acceptability, embeddings, generation).  Here a backend is a
factory returning an object with ``predict(texts) -> list``; Spark runs it
with ``pyspark.ml.functions.predict_batch_udf``: Arrow batches of
``batch_size`` rows, the model loaded once per Python worker and cached.

Defaults that need no Python at all live in ``functions.scorers`` (expression
backends).  Supervised defaults, for toxicity and acceptability, are
:func:`fit_text_model`, a Spark ML pipeline trained on the ``labels`` table.

Backends are marked non-deterministic: a filter on a deterministic Python
UDF's output makes Spark evaluate the UDF twice, and sampling generators
must not change between a task and its retry.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, IDF, Normalizer, RegexTokenizer
from pyspark.ml.functions import predict_batch_udf, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def batch_scorer(factory: Callable[[], object], return_type=T.DoubleType(), batch_size: int = 32):
    """Wrap a backend factory as an Arrow-batched UDF over one string column.

    ``factory()`` must return an object with ``predict(list[str]) -> list``;
    it is called once per Python worker (``predict_batch_udf`` caches it).
    """
    def make_predict():
        model = factory()

        def predict(texts):
            import numpy as np
            out = model.predict([("" if t is None else str(t)) for t in texts])
            return np.asarray(out, dtype=float) if isinstance(return_type, T.DoubleType) else np.asarray(out)
        return predict

    udf = predict_batch_udf(make_predict, return_type=return_type, batch_size=batch_size)
    return udf.asNondeterministic() if hasattr(udf, "asNondeterministic") else udf


class LexiconToxicity:
    """A Python twin of the lexicon expression scorer (for tests of the UDF path)."""

    def __init__(self, k: float = 1.0):
        import re

        from ..sources.fixtures import LEXICON
        self.k = k
        self.pattern = re.compile(r"\b(" + "|".join(LEXICON) + r")\b", re.IGNORECASE)

    def predict(self, texts):
        import math
        return [1.0 - math.exp(-self.k * len(self.pattern.findall(t))) for t in texts]


#: Labelled documents that a model is fitted on, at most.
FIT_ROWS = 20_000


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int = FIT_ROWS, key: str = "doc_id") -> DataFrame:
    """(text, label) of at most ``rows`` labelled documents, those with the least
    hash of their key: a reproducible sample of bounded size, broadcast to the scan."""
    some = labels.where(F.col(label).isNotNull()).select(key, label).orderBy(F.xxhash64(key), key).limit(rows)
    return docs.join(F.broadcast(some), key).select("text", label)


def fit_text_model(train: DataFrame, text: str = "text", label: str = "toxic",
                   num_features: int = 1 << 18, max_iter: int = 30) -> PipelineModel:
    """Supervised backend (UDF-01b, UDF-02): tokens -> hashed TF -> IDF -> LR.

    Every stage is a distributed Spark ML estimator; nothing is collected.  NULL
    texts count as empty.
    """
    pipe = Pipeline(stages=[
        RegexTokenizer(inputCol=text, outputCol="__tok", pattern=r"\W+", toLowercase=True),
        HashingTF(inputCol="__tok", outputCol="__tf", numFeatures=num_features),
        IDF(inputCol="__tf", outputCol="__feat"),
        LogisticRegression(featuresCol="__feat", labelCol=label, maxIter=max_iter, regParam=0.01,
                           probabilityCol="__prob", rawPredictionCol="__raw", predictionCol="__pred"),
    ])
    return pipe.fit(train.select(F.coalesce(F.col(text), F.lit("")).alias(text), F.col(label).cast("double").alias(label)))


def score_with_model(model: PipelineModel, df: DataFrame, text: str = "text", out: str = "p_toxic") -> DataFrame:
    """Apply a fitted pipeline: ``p(class 1)`` as a DOUBLE column."""
    scored = model.transform(df.withColumn(text, F.coalesce(F.col(text), F.lit(""))))
    return scored.select(*df.columns, vector_to_array(F.col("__prob"))[1].alias(out))


def with_hashed_cosine(df: DataFrame, a: str, b: str, out: str = "sim", num_features: int = 1 << 18) -> DataFrame:
    """Vector-valued similarity backend (UDF-03): tokens -> HashingTF ->
    Normalizer, then the dot product of the two unit vectors (0 without tokens)."""
    cols = []
    for side, name in (("a", a), ("b", b)):
        raw, t, f, u = f"__{side}", f"__{side}t", f"__{side}f", f"__{side}u"
        df = df.withColumn(raw, F.coalesce(F.col(name), F.lit("")))
        for stage in (RegexTokenizer(inputCol=raw, outputCol=t, pattern=r"\s+", toLowercase=True),
                      HashingTF(inputCol=t, outputCol=f, numFeatures=num_features),
                      Normalizer(inputCol=f, outputCol=u, p=2.0)):
            df = stage.transform(df)
        # the sparse vector's own indices and values: the dot product stays in the plan
        df = df.withColumn(u, F.unwrap_udt(F.col(u))).drop(raw, t, f)
        cols.append(u)
    left, right = F.col(cols[0]), F.col(cols[1])
    shared = F.array_intersect(left["indices"], right["indices"])
    value = lambda v, i: F.element_at(v["values"], F.array_position(v["indices"], i).cast("int"))
    dot = F.aggregate(shared, F.lit(0.0), lambda acc, i: acc + value(left, i) * value(right, i))
    return df.withColumn(out, dot).drop(*cols)


def auc(df: DataFrame, score: str, label: str) -> float:
    """Area under ROC via the rank-sum formula, computed by Spark (one small action)."""
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    ev = BinaryClassificationEvaluator(rawPredictionCol=score, labelCol=label, metricName="areaUnderROC")
    return ev.evaluate(df.select(F.col(score).cast("double").alias(score), F.col(label).cast("double").alias(label)))

