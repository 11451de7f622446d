"""End-to-end jobs (RPT-01, RPT-05..09): what a ``spark-submit`` main calls.

Each job reads its inputs, builds one DataFrame plan and writes outputs with
Spark writers.  Intermediate results read twice are checkpointed to the
shared ``spark.checkpoint.dir`` (reliable, survives executor loss), never
``localCheckpoint``.
"""

from __future__ import annotations

import inspect
import json
import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metrics as M
from ..operators import prepare as P
from ..operators import rerank as RR
from ..operators import runs as RU
from ..operators import sampling as SM
from ..session import ensure_checkpoint_dir
from ..functions.text import reference_fallback
from ..sources import files as IO


def evaluate_job(spark: SparkSession, tsv_path: str, output_col: str = "model_output",
                 reference_col: str = "neutral1", source_col: str = "toxic",
                 by: Sequence[str] = (), threshold: float = 0.5) -> DataFrame:
    """Evaluate a prediction TSV (RPT-07): BLEU, STA, SIM, FL, J (per ``by``)."""
    df = IO.read_tsv(spark, tsv_path)
    IO.require_columns(df, [source_col, reference_col, output_col])
    return M.evaluate_pairs(df, source_col, reference_col, output_col, by=by, threshold=threshold)


def checked_align(inputs: DataFrame, predictions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Predictions aligned to inputs by key; an input without one, or a
    prediction without an input, is an error that says how many (JN-03)."""
    from .catalog_more import align
    joined = align(inputs, predictions, keys)
    lost = predictions.join(inputs.select(*keys), list(keys), "left_anti").count()
    missing = joined.where(~F.col("matched")).count()
    if missing or lost:
        raise ValueError(f"{missing} inputs have no prediction and {lost} predictions no input")
    return joined.drop("matched")


def _read_once(spark: SparkSession, tsv_path: str) -> DataFrame:
    """A TSV with ``row_id``, written to the checkpoint folder: records are put
    together once, whatever number of outputs a job has."""
    ensure_checkpoint_dir(spark)
    return IO.read_tsv(spark, tsv_path, row_id="row_id").checkpoint()


def prepare_job(spark: SparkSession, tsv_path: str, seed: int = 42, min_len: int = 5):
    """Prepare + split with counts (RPT-08): returns ``(pairs_with_split, audit)``."""
    wide = _read_once(spark, tsv_path)
    IO.require_columns(wide, ["toxic", "neutral1"])
    pairs = P.prepare_pairs(wide, keep=["row_id"], min_len=min_len)
    return SM.split_exact(pairs, seed, ["row_id", "target_no"]), P.prepare_audit(wide, min_len=min_len)


def select_samples(df: DataFrame, source: str, reference: str, max_samples: int | None,
                   strategy: str = "head", seed: int | None = None, order: str = "row_id") -> DataFrame:
    """A missing reference falls back to the source (PRJ-06, T24), a missing
    source drops the row -> optional head/random cap -> dense ``sample_id``
    0..n-1 (SMP-01/02/08, T18)."""
    df = df.withColumn(reference, reference_fallback(F.col(reference), F.col(source))).na.drop(subset=[source])
    if max_samples:
        if (strategy or "head").lower() == "random":
            df = SM.sample_exact(df, int(max_samples), int(seed or 0), [order])
        else:
            df = SM.head(df, int(max_samples), [order])
    ranked = SM.dense_ids(df, F.floor(F.col(order) / 65536), F.col(order), name="sample_id")
    return ranked.select("sample_id", F.col(source).alias("source"), F.col(reference).alias("reference"))


def rerank_job(spark: SparkSession, cfg: dict, samples: DataFrame | None = None,
               output_dir: str | None = None, generators: dict | None = None) -> dict[str, DataFrame]:
    """The rerank job (RPT-05/06): samples -> candidates -> scores -> top-1 ->
    corpus metrics; writes the four outputs when ``output_dir`` is given.

    ``samples`` (sample_id, source, reference) may be any DataFrame -- one
    row, a TSV, a table -- otherwise the config's dataset TSV is read.
    ``generators`` maps a config model name to a Python generator factory
    (``mapInPandas`` backend, called with the model's effective generation
    settings if it takes them); every other model must be a rule model.  What generators return
    is checkpointed before it is used, so a retried task can't change it.
    Config order defines ``model_idx`` for both kinds, so ties follow it (T10).
    """
    from ..operators.candidates import RULE_MODELS, candidates, python_candidates
    scoring = cfg.get("scoring") or {}
    model_cfgs = cfg.get("models") or []
    if not model_cfgs:
        raise ValueError("the config lists no models")
    generators = generators or {}
    names = [m.get("name") or str(m.get("path", "")).rstrip("/").split("/")[-1] for m in model_cfgs]
    unknown = [n for n in names if n not in RULE_MODELS and n not in generators]
    if unknown:
        raise ValueError(f"model {unknown[0]!r} is neither a rule model nor given a generator")
    if samples is None:
        raw = _read_once(spark, cfg.get("dataset_path"))
        samples = select_samples(raw, cfg.get("source_column", "toxic"), cfg.get("reference_column", "neutral1"),
                                 cfg.get("max_samples"), cfg.get("sample_strategy", "head"), cfg.get("sample_seed"))
    options = {"weights": scoring.get("objective_weights"), "threshold": float(scoring.get("toxicity_threshold", 0.5))}
    if not any(n in generators for n in names):
        scored, _ = RR.rerank(samples, models=names, **options)
        return _finish_rerank(spark, cfg, scored, output_dir)
    # with generators, rule models keep their config position as rows of their own
    ensure_checkpoint_dir(spark)
    samples = samples.checkpoint(eager=True)
    every = None
    for idx, (name, mcfg) in enumerate(zip(names, model_cfgs, strict=True)):
        if name in generators:
            settings = RU.generation_settings(mcfg.get("generation"), cfg.get("generation"))
            wants = bool(inspect.signature(generators[name]).parameters)  # a factory may do without settings
            part = python_candidates(samples, generators[name], idx, name, int(settings["num_return_sequences"]),
                                     params=settings if wants else None)
            part = part.checkpoint(eager=True)
        else:
            part = candidates(samples, [name]).withColumn("model_idx", F.lit(idx))
        every = part if every is None else every.unionByName(part)
    scored, _ = RR.rerank(samples, models=[], extra_candidates=every, **options)
    return _finish_rerank(spark, cfg, scored, output_dir)


def _finish_rerank(spark: SparkSession, cfg: dict, scored: DataFrame, output_dir: str | None) -> dict:
    # both outputs read the scored candidates: cut the lineage once, reliably
    ensure_checkpoint_dir(spark)
    scored = scored.checkpoint(eager=True)
    best = RR.top1(scored)
    out = {"all_candidates": RR.all_candidate_rows(scored), "selected": RR.selected_rows(best),
           "metrics": RR.corpus_metrics(best)}
    if output_dir and not scored.isEmpty():  # a run without outputs writes nothing (T19)
        IO.write_tsv(out["all_candidates"], os.path.join(output_dir, "all_candidates.tsv"))
        IO.write_tsv(out["selected"].orderBy("sample_id"), os.path.join(output_dir, "reranked_outputs.tsv"))
        IO.write_metrics_json(out["metrics"].select("BLEU", "STA", "SIM", "FL", "J"),
                              os.path.join(output_dir, "metrics.json"))
        IO.write_metrics_json(IO.config_frame(spark, cfg), os.path.join(output_dir, "config.used.json"))
    return out


def rollup_job(spark: SparkSession, root: str, output: str | None = None) -> DataFrame:
    """Run roll-up (RPT-01): one row for every metrics.txt below ``root`` (two
    folders of one name are two rows), sorted."""
    lines = IO.read_metrics_tree(spark, root)
    summary = RU.run_summary(RU.parse_metric_lines(lines, by=["path"]), by=["path"]).drop("path")
    if output:
        IO.write_csv(summary, output)
    return summary


def log_report_job(spark: SparkSession, logs: str) -> dict[str, DataFrame]:
    """Run logs (RPT-04): per-epoch history with the global step, and the failed
    runs with their error text."""
    parsed = RU.parse_log_lines(IO.read_step_logs(spark, logs))
    return {"history": RU.epoch_history(parsed), "failures": RU.log_failures(parsed)}


def main(argv: Sequence[str] | None = None) -> None:
    """``python -m rewrite_lake.plans.jobs rerank --config c.json [--override '{..}'] [--out dir]``."""
    import argparse

    from ..session import get_session
    parser = argparse.ArgumentParser()
    parser.add_argument("job", choices=["rerank", "evaluate", "rollup"])
    parser.add_argument("--config")
    parser.add_argument("--override")
    parser.add_argument("--input")
    parser.add_argument("--out")
    a = parser.parse_args(argv)
    spark = get_session()
    if a.job == "rerank":
        cfg = IO.read_run_config(a.config, a.override)
        res = rerank_job(spark, cfg, output_dir=a.out or cfg.get("output_dir"))
        print(json.dumps(res["metrics"].first().asDict()))
    elif a.job == "evaluate":
        print(json.dumps(evaluate_job(spark, a.input).first().asDict()))
    else:
        rollup_job(spark, a.input, a.out).show(truncate=False)


if __name__ == "__main__":
    main()
