"""Prepare: clean and unpivot wide pair tables (RSH-01, FLT-01..03, AGG-01).

Filters run before any model work so Catalyst can push them to the scan; the
unpivot is a ``posexplode`` (a narrow Generate, no shuffle).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import char_len, ustrip

TARGET_COLUMNS = ("neutral1", "neutral2", "neutral3")


def drop_incomplete(df: DataFrame, subset) -> DataFrame:
    """``dropna(subset=...)``: drop rows with a NULL in any named column (FLT-01)."""
    return df.na.drop(how="any", subset=list(subset))


def prepare_pairs(df: DataFrame, source: str = "toxic", targets=TARGET_COLUMNS,
                  min_len: int = 5, keep=()) -> DataFrame:
    """One (input, target) row per surviving target, in column order (RSH-01).

    * source and targets are stripped of Unicode whitespace (T8);
    * the source must have >= ``min_len`` characters after strip -- a NULL
      source fails this, like the reference's ``"nan"`` (T5);
    * target columns that do not exist are skipped, NULL targets are dropped,
      short ones too (FLT-02/03).

    ``keep`` names pass-through key columns (e.g. a row id).  Output:
    ``*keep, target_no (1-based), input, target``.
    """
    present = [c for c in targets if c in df.columns]
    src = ustrip(F.col(source))
    base = df.select(*keep, src.alias("input"),
                     *[ustrip(F.col(c)).alias(f"__t{i}") for i, c in enumerate(present)])
    base = base.where(char_len(F.col("input")) >= min_len)
    if not present:
        return base.select(*keep, F.lit(None).cast("int").alias("target_no"),
                           "input", F.lit(None).cast("string").alias("target")).limit(0)
    exploded = base.select(
        *keep, "input",
        F.posexplode(F.array(*[F.col(f"__t{i}") for i in range(len(present))])).alias("pos", "target"))
    return exploded.where(F.col("target").isNotNull() & (char_len(F.col("target")) >= min_len)).select(
        *keep, (F.col("pos") + 1).cast("int").alias("target_no"), "input", "target")


def prepare_audit(wide: DataFrame, source: str = "toxic", targets=TARGET_COLUMNS,
                  min_len: int = 5) -> DataFrame:
    """Row counts before and after prepare in one pass (AGG-01).

    ``rows_in``, ``sources_kept`` and ``pairs_out``; the pair count is a sum of
    per-row survivor counts, so no explode and no second scan is needed.
    """
    present = [c for c in targets if c in wide.columns]
    src_ok = char_len(ustrip(F.col(source))) >= min_len
    survivors = sum((F.when(F.col(c).isNotNull() & (char_len(ustrip(F.col(c))) >= min_len), 1)
                     .otherwise(0) for c in present), F.lit(0))
    return wide.agg(
        F.count(F.lit(1)).alias("rows_in"),
        F.count(F.when(src_ok, 1)).alias("sources_kept"),
        F.coalesce(F.sum(F.when(src_ok, survivors).otherwise(0)), F.lit(0)).cast("bigint").alias("pairs_out"))
