"""Run reports: roll-ups, run matrix, ablations, training-log analytics,
model registry (RPT-01..04, RPT-09; RSH-02/04, JN-05..07, FLT-04/05/08/09,
SRT-01/03, PRJ-18..21, WIN-05, AGG-09/10).

All are small-result aggregations over tables that grow with the number of
runs/lines; pivots name their values explicitly so Spark does not run an
extra job to discover them.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ustrip

SUMMARY_KEYS = ("BLEU", "STA", "SIM", "FL", "J")  # fixed values: roll-up keys, in output order


# --- metric text lines ------------------------------------------------------------

def parse_metric_lines(lines: DataFrame, run: str = "run", line: str = "line",
                       line_no: str = "line_no", by: Sequence[str] = ()) -> DataFrame:
    """``KEY: value`` lines -> (*by, run, key, value, line_no) (PRJ-19, FLT-04).

    Split once on ':' and strip both sides of all Unicode whitespace; keep the 5
    summary keys; a non-numeric value is skipped (``try_cast``; Spark 4 casts
    are ANSI).  ``by`` names further key columns, such as the file's path.
    """
    parts = F.split(ustrip(F.col(line)), ":", 2)
    df = lines.where(F.instr(F.col(line), ":") > 0).select(
        *by, F.col(run).alias("run"), F.col(line_no).alias("line_no"), ustrip(F.element_at(parts, 1)).alias("key"),
        ustrip(F.element_at(parts, 2)).try_cast("double").alias("value"))
    return df.where(F.col("key").isin(*SUMMARY_KEYS) & F.col("value").isNotNull())


def canonical_order(df: DataFrame, desired: Sequence[str]) -> DataFrame:
    """``df`` with its columns sorted by their place in ``desired``; the rest
    keep their order behind those (SRT-03)."""
    place = {name: i for i, name in enumerate(desired)}
    return df.select(*sorted(df.columns, key=lambda name: place.get(name, len(place))))


def run_summary(metrics: DataFrame, model: str = "run", by: Sequence[str] = ()) -> DataFrame:
    """Roll-up (RPT-01): one row per run with BLEU, STA, SIM, FL, J.

    Runs are told apart by ``model`` and the columns ``by`` (the file's path:
    two folders of one name are two rows).  The last occurrence of a duplicated
    key wins (``max_by(value, line_no)``), values are rounded to 4 decimals,
    runs with no metric drop out (inner pivot), rows sort by J descending with
    NULL last, then by name.
    """
    wide = metrics.groupBy(*by, F.col(model).alias("Model")).pivot("key", list(SUMMARY_KEYS)).agg(
        F.max_by("value", "line_no"))
    rounded = wide.select(*by, "Model", *[F.round(F.col(k), 4).alias(k) for k in SUMMARY_KEYS])
    return canonical_order(rounded, ["Model", *SUMMARY_KEYS]).orderBy(F.col("J").desc_nulls_last(), F.col("Model"), *by)


def metric_lines(df: DataFrame, run: str, with_header: bool = True) -> DataFrame:
    """Render summary rows as ``KEY: value`` text lines (SNK-03 layout).

    Optional header: a ``Model: x`` line and a dashed rule, as some of the
    reference's files have.
    """
    items = []
    if with_header:
        items.append(F.struct(F.lit(0).alias("line_no"), F.concat(F.lit("Model: "), F.col(run)).alias("line")))
        items.append(F.struct(F.lit(1).alias("line_no"), F.lit("-" * 30).alias("line")))
    for i, k in enumerate(SUMMARY_KEYS):
        items.append(F.struct(F.lit(2 + i).alias("line_no"),
                              F.concat(F.lit(f"{k}: "), F.col(k).cast("string")).alias("line")))
    return df.select(F.col(run).alias("run"), F.inline(F.array(*items)))


# --- run matrix and ablations ----------------------------------------------------------

def run_matrix(models: DataFrame, variants: Sequence[str], metrics: DataFrame,
               value_cols: Sequence[str], model: str = "model", variant: str = "variant",
               failures: DataFrame | None = None) -> DataFrame:
    """Every model x variant with its metrics, ``N/A`` where a run is missing (JN-06).

    The variant list is a short config list, expanded per model with
    ``explode`` (no cross join); the metrics join is an equi left join.
    ``failures`` (model, variant, reason) -- e.g. :func:`log_failures` --
    adds a ``status`` column: ``ok``, the failure reason, or ``missing``.
    """
    grid = models.select(model).distinct().select(
        model, F.explode(F.array(*[F.lit(v) for v in variants])).alias(variant))
    joined = grid.join(metrics.select(model, variant, *value_cols, F.lit(True).alias("__has")),
                       [model, variant], "left")
    # four decimals, no thousands separators
    cols = [model, variant, *[F.when(F.col(c).isNull(), F.lit("N/A")).otherwise(F.format_string("%.4f", F.col(c))).alias(c)
                              for c in value_cols]]
    if failures is not None:
        joined = joined.join(failures.select(model, variant, "reason"), [model, variant], "left")
        cols.append(F.when(F.col("__has"), F.lit("ok")).otherwise(
            F.coalesce(F.col("reason"), F.lit("missing"))).alias("status"))
    return joined.select(*cols)


def log_failures(parsed: DataFrame, variant_of_dir: dict[str, str] | None = None) -> DataFrame:
    """Failed runs from parsed logs: (model, variant, reason): the last error
    line of each file, class and message.  The model is the file name before its
    ``_YYYYMMDD_HHMMSS`` stamp; the variant is the parent folder (mapped through
    ``variant_of_dir`` when given; '' for a file without a folder)."""
    parts = F.split(F.col("file"), "/")
    name, folder = F.try_element_at(parts, F.lit(-1)), F.coalesce(F.try_element_at(parts, F.lit(-2)), F.lit(""))
    errs = parsed.where(F.col("kind") == "error").groupBy("file").agg(
        F.max_by(F.concat_ws(": ", "error", F.nullif(F.col("message"), F.lit(""))), "line_no").alias("reason"))
    variant = folder
    if variant_of_dir:
        variant = F.coalesce(F.create_map(*[x for kv in variant_of_dir.items() for x in map(F.lit, kv)])[folder],
                             folder)
    return errs.select(F.regexp_replace(name, r"_\d{8}_\d{6}\.log$", "").alias("model"),
                       variant.alias("variant"), "reason")


def complete_models(metrics: DataFrame, variants: Sequence[str], model: str = "model",
                    variant: str = "variant") -> DataFrame:
    """Models that have every listed variant (FLT-09)."""
    return metrics.where(F.col(variant).isin(*variants)).groupBy(model).agg(
        F.countDistinct(variant).alias("__k")).where(F.col("__k") == len(variants)).select(model)


def ablation(metrics: DataFrame, variants: Sequence[str], baseline: str, value_cols: Sequence[str],
             model: str = "model", variant: str = "variant") -> DataFrame:
    """The ablation of models that have every variant (FLT-09 -> JN-07): each
    other variant minus the baseline, incomplete models left out."""
    full = metrics.join(complete_models(metrics, variants, model, variant), model, "left_semi")
    return ablation_delta(full.where(F.col(variant).isin(*variants)), baseline, value_cols, model, variant)


def ablation_pivot(metrics: DataFrame, variants: Sequence[str], value: str,
                   model: str = "model", variant: str = "variant") -> DataFrame:
    """Model x variant table of one metric (RSH-04)."""
    return metrics.groupBy(model).pivot(variant, list(variants)).agg(F.first(value))


def ablation_delta(metrics: DataFrame, baseline: str, value_cols: Sequence[str],
                   model: str = "model", variant: str = "variant") -> DataFrame:
    """Each variant minus the model's baseline variant (JN-07): equi join on model."""
    base = metrics.where(F.col(variant) == baseline).select(
        model, *[F.col(c).alias(f"__base_{c}") for c in value_cols])
    other = metrics.where(F.col(variant) != baseline)
    return other.join(base, model).select(
        model, variant, *[(F.col(c) - F.col(f"__base_{c}")).alias(f"delta_{c}") for c in value_cols])


# --- training logs ---------------------------------------------------------------------

# The run-log line formats (epoch header, step, eval, error).
STEP_RE = r"^\s*Step\s+(\d+):\s+reward=(\S+)\s+loss=(\S+)\s+kl=(\S+)"
EPOCH_RE = r"^Epoch\s+(\d+)/(\d+)"
EVAL_RE = r"^\s*Eval reward=(\S+)\s+toxicity=(\S+)"
ERROR_RE = r"^([A-Za-z_][A-Za-z0-9_.]*(?:Error|Exception)):\s*(.*)$"


def parse_log_lines(lines: DataFrame, file: str = "file", line: str = "line",
                    line_no: str = "line_no") -> DataFrame:
    """Classify and parse run-log lines (SRC-05) and forward-fill the epoch (WIN-05).

    Step lines carry no epoch: each takes the last ``Epoch k/n`` above it in
    the same file -- ``last(ignorenulls)`` over a running frame partitioned by
    file (a file is one run).
    """
    t = F.col(line)
    kind = (F.when(t.rlike(EPOCH_RE), "epoch").when(t.rlike(STEP_RE), "step")
            .when(t.rlike(EVAL_RE), "eval").when(t.rlike(ERROR_RE), "error").otherwise("other"))
    df = lines.select(F.col(file).alias("file"), F.col(line_no).alias("line_no"), t.alias("line"),
                      kind.alias("kind"))

    def num(pattern, i, typ="double"):
        return F.nullif(F.regexp_extract("line", pattern, i), F.lit("")).try_cast(typ)

    df = df.select(
        "file", "line_no", "kind",
        F.when(F.col("kind") == "epoch", num(EPOCH_RE, 1, "int")).alias("epoch_mark"),
        F.when(F.col("kind") == "step", num(STEP_RE, 1, "int")).alias("step"),
        F.when(F.col("kind") == "step", num(STEP_RE, 2)).when(F.col("kind") == "eval", num(EVAL_RE, 1)).alias("reward"),
        F.when(F.col("kind") == "step", num(STEP_RE, 3)).alias("loss"),
        F.when(F.col("kind") == "step", num(STEP_RE, 4)).alias("kl"),
        F.when(F.col("kind") == "eval", num(EVAL_RE, 2)).alias("toxicity"),
        F.when(F.col("kind") == "error", F.regexp_extract("line", ERROR_RE, 1)).alias("error"),
        F.when(F.col("kind") == "error", F.regexp_extract("line", ERROR_RE, 2)).alias("message"))
    return forward_fill(df, ["file"], "line_no", "epoch_mark", "epoch").drop("epoch_mark")


def forward_fill(df: DataFrame, partition: Sequence[str], order: str, value: str, out: str,
                 block: int = 4096) -> DataFrame:
    """``out`` = last non-NULL ``value`` at or before each row, per ``partition``,
    in ``order`` (numeric) -- WIN-05 without one task per partition.

    Two levels with bounded groups: a running ``last(ignorenulls)`` inside
    blocks of ``block`` consecutive order values, then the carry from the
    preceding blocks, computed on a per-block table (``rows / block`` small
    rows per partition) and joined back on (partition, block).
    """
    keys = list(partition)
    d = df.withColumn("__blk", F.floor(F.col(order) / F.lit(block)).cast("bigint"))
    w1 = Window.partitionBy(*keys, "__blk").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = d.withColumn("__in", F.last(value, ignorenulls=True).over(w1))
    # every block, with its last non-NULL value (NULL when it has none)
    blocks = d.groupBy(*keys, "__blk").agg(
        F.max_by(F.col(value), F.when(F.col(value).isNotNull(), F.col(order))).alias("__blast"))
    w2 = Window.partitionBy(*keys).orderBy("__blk").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(*keys, "__blk", F.last("__blast", ignorenulls=True).over(w2).alias("__prev"))
    j = d.join(blocks, [*keys, "__blk"], "left")
    return j.withColumn(out, F.coalesce(F.col("__in"), F.col("__prev"))).drop("__blk", "__in", "__prev")


def epoch_history(steps: DataFrame, by: Sequence[str] = ("file",)) -> DataFrame:
    """Step rows -> per-epoch summary with the last global step (AGG-09).

    A log's step number restarts in each epoch; the global step adds the steps
    of the epochs before (a window over one row per epoch of a run).
    """
    each = steps.where(F.col("kind") == "step").groupBy(*by, "epoch").agg(
        F.count(F.lit(1)).alias("steps"), F.avg("reward").alias("reward_mean"),
        F.avg("loss").alias("loss_mean"), F.avg("kl").alias("kl_mean"), F.max("step").alias("__last"))
    upto = Window.partitionBy(*by).orderBy("epoch").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return each.withColumn("last_step", F.sum("__last").over(upto)).drop("__last")


def best_checkpoint(evals: DataFrame, step: str = "step", loss: str = "eval_loss",
                    by: Sequence[str] = ()) -> DataFrame:
    """Best step = argmin eval loss; retention keeps best and last (AGG-10)."""
    return evals.where(F.col(loss).isNotNull()).groupBy(*by).agg(
        F.min_by(step, F.struct(F.col(loss), F.col(step))).alias("best_step"),
        F.min(loss).alias("best_metric"), F.max(step).alias("last_step"))


# --- model registry ----------------------------------------------------------------------

# Generation defaults used when neither the model nor the global
# config sets a key; a None stays unset.
GENERATION_DEFAULTS = {"max_new_tokens": 60, "num_beams": 4, "do_sample": False, "temperature": 1.0,
                       "top_p": 0.92, "top_k": 50, "num_return_sequences": 1,
                       "early_stopping": None, "length_penalty": None}
_GENERATION_TYPES = {"max_new_tokens": "int", "num_beams": "int", "do_sample": "boolean", "temperature": "double",
                     "top_p": "double", "top_k": "int", "num_return_sequences": "int",
                     "early_stopping": "boolean", "length_penalty": "double"}
_SAMPLING_ONLY = ("top_p", "top_k")


def generation_settings(own: dict | None, shared: dict | None) -> dict:
    """Effective settings of one model (PRJ-21) as a dict: its own value, else
    the shared one, else the default; unset keys, and sampling keys without
    sampling, are left out."""
    out = {k: (own or {}).get(k, (shared or {}).get(k, d)) for k, d in GENERATION_DEFAULTS.items()}
    return {k: v for k, v in out.items() if v is not None and (out["do_sample"] or k not in _SAMPLING_ONLY)}


def effective_generation(model_gen_json: Column | None, global_gen: dict) -> list[Column]:
    """The same per row: ``model_gen_json`` is a model's own ``generation``
    object as JSON text (absent keys read as NULL, so models may override any
    subset)."""
    out = {}
    for k, default in GENERATION_DEFAULTS.items():
        out[k] = F.lit(global_gen.get(k, default)).cast(_GENERATION_TYPES[k])
        if model_gen_json is not None:
            out[k] = F.coalesce(F.get_json_object(model_gen_json, f"$.{k}").try_cast(_GENERATION_TYPES[k]), out[k])
    return [(F.when(out["do_sample"], c) if k in _SAMPLING_ONLY else c).alias(k) for k, c in out.items()]


def registry(families: Sequence[tuple[str, DataFrame]], hints: DataFrame | None = None,
             eligible: str = "has_final_model", root: str = "models", generation: dict | None = None) -> DataFrame:
    """Union model families (tagged) -> batch size capped by per-model hints
    -> only eligible models (SET-01, JN-05, FLT-08).

    A row's ``name`` is tagged with its family, its ``path`` lies under ``root``
    and the family, and ``generation`` (family -> settings) gives the family's
    overrides as JSON.  ``batch_size`` is the lesser of the model's own and its
    hint; either may be unset, and without both it stays unset.  The join is
    left to the planner, which knows the size of ``hints``.
    """
    generation = generation or {}
    parts = []
    for tag, df in families:
        if "batch_size" not in df.columns:
            df = df.withColumn("batch_size", F.lit(None).cast("int"))
        parts.append(df.select("*", F.lit(tag).alias("family"), F.concat_ws("-", F.col("model"), F.lit(tag)).alias("name"),
                               F.concat_ws("/", F.lit(root), F.lit(tag), F.col("model")).alias("path"),
                               F.lit(json.dumps(generation.get(tag) or {}, sort_keys=True)).alias("generation")))
    allm = parts[0]
    for p in parts[1:]:
        allm = allm.unionByName(p, allowMissingColumns=True)
    allm = allm.where(F.col(eligible))
    if hints is not None:
        allm = allm.join(hints.select("model", "batch_hint"), "model", "left")
        # least() skips NULLs: an unset side leaves the other
        allm = allm.withColumn("batch_size", F.least(F.col("batch_size"), F.col("batch_hint"))).drop("batch_hint")
    return allm
