"""Candidate generation (UDF-05, RSH-03, SET-02, PRJ-22, JN-04).

A "model" turns a sample's source into K candidate rewrites.  The reference
loops over models and batches; here all candidates of a sample are produced
from the sample row in one ``inline`` of an array of structs, so

* there is no join and no cross product: the model list is a driver-side
  config (bounded by the config file), compiled into one projection;
* candidates of a sample stay in the sample's partition, which lets the
  per-sample top-1 aggregate finish map-side (one row per sample shuffled);
* ``model_idx`` (config order) and ``candidate_rank`` keep the reference's
  generation order for tie-breaking (T10).

Rule models are Column expressions (deterministic, codegen'd).  Python models
(e.g. seq2seq generators) use :func:`python_candidates`, a pandas UDF
backend that loads the model once per worker and batches rows via Arrow.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ustrip
from ..sources.fixtures import drop_lexicon, half_split, mask_lexicon

RuleModel = Callable[[Column], list[Column]]


def _first_line(src: Column) -> list[Column]:
    return [F.element_at(F.split(src, "\n", -1), 1)]


# Rule "models": name -> K candidate expressions (candidate_rank = list index).
RULE_MODELS: dict[str, RuleModel] = {
    "identity": lambda src: [src],
    "drop": lambda src: [drop_lexicon(src)],
    "mask": lambda src: [mask_lexicon(src)],
    "half": lambda src: list(half_split(src)),
    "first_line": _first_line,
}

DEFAULT_MODELS = ("identity", "drop", "mask", "half")


def candidate_array(models: Sequence[str] = DEFAULT_MODELS, source: str = "source") -> Column:
    """All candidates of a sample as one ``array<struct<model_idx, model,
    candidate_rank, text>>`` in generation order.  ``text`` is the rewrite
    stripped of surrounding whitespace, like decoded model output."""
    if not models:
        raise ValueError("no models given: nothing would propose candidates")
    src = F.col(source)
    structs = []
    for idx, name in enumerate(models):
        if name not in RULE_MODELS:
            raise ValueError(f"unknown rule model {name!r}; known: {sorted(RULE_MODELS)}")
        for rank, expr in enumerate(RULE_MODELS[name](src)):
            structs.append(F.struct(F.lit(idx).alias("model_idx"), F.lit(name).alias("model"),
                                    F.lit(rank).alias("candidate_rank"), ustrip(expr).alias("text")))
    return F.array(*structs)


def candidates(samples: DataFrame, models: Sequence[str] = DEFAULT_MODELS,
               source: str = "source", keep: Sequence[str] = ("sample_id",)) -> DataFrame:
    """Explode every sample into its candidates.

    Output: ``*keep, model_idx, model, candidate_rank, text``.
    """
    return samples.select(*keep, F.inline(candidate_array(models, source)))


def python_candidates(samples: DataFrame, generator_factory, model_idx: int, model: str,
                      num_return: int, source: str = "source", key: str | Sequence[str] = "sample_id",
                      params: dict | None = None) -> DataFrame:
    """Candidates from a Python generator backend as an Arrow-batched UDF.

    ``generator_factory()`` returns an object with ``generate(list[str]) ->
    list[list[str]]`` (``num_return`` rewrites per prompt); with ``params`` it is
    called as ``generator_factory(params)``, the effective generation settings.
    It is built once per Python worker; rows arrive in Arrow batches.  ``key`` is
    one column or several, of any types; the keys go past the generator in the JVM.
    A NULL source is prompted as ''.  A generator that answers for fewer prompts, or
    with another number of rewrites than promised, is an error: no sample and no
    rewrite is dropped.
    """
    import pandas as pd
    keys = [key] if isinstance(key, str) else list(key)

    def run(batches):
        gen = generator_factory(params) if params is not None else generator_factory()
        for prompts in batches:
            prompts = prompts.tolist()
            outs = list(gen.generate(prompts))
            if len(outs) != len(prompts):
                raise ValueError(f"{model}: {len(outs)} answers for {len(prompts)} prompts")
            for prompt, texts in zip(prompts, outs, strict=True):
                if len(texts) != num_return:
                    raise ValueError(f"{model}: {len(texts)} rewrites of {prompt[:40]!r}, not {num_return}")
            yield pd.Series([[(t or "").strip() for t in texts] for texts in outs])

    # each prompt is asked once: a generator that samples must not be run twice for one row
    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    answer = F.pandas_udf(run, "array<string>").asNondeterministic()
    asked = samples.select(*keys, answer(F.coalesce(F.col(source).cast("string"), F.lit(""))).alias("__texts"))
    return asked.select(*keys, F.lit(model_idx).alias("model_idx"), F.lit(model).alias("model"),
                        F.posexplode("__texts").alias("candidate_rank", "text"))
