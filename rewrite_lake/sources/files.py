"""File sources and sinks (SRC-01..07, SNK-01..05).

Every reader returns a DataFrame with an explicit schema where the format
allows it; nothing is collected to the driver except small config files.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import PANDAS_NA_TOKENS, na_to_null, ustrip

# Spark's CSV writer trims whitespace by default, turning " " into "" which
# reads back as NULL (T7): keep whitespace and use '"' as the escape char.
_CSV_IO = {"sep": "\t", "header": "true", "quote": '"', "escape": '"',
           "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


#: A field of a tab-separated line, and whether a line that begins outside (0) or
#: inside (1) a quoted field ends outside.  Quotes open only at a field's start, a
#: doubled quote is a character, and what follows a closing quote runs to the tab.
_FIELD = r'(?:"(?:[^"]++|"")*+"[^\t]*+|[^"\t][^\t]*+|)'
_ENDS_OUTSIDE = (rf'\A{_FIELD}(?:\t{_FIELD})*+\z', rf'\A(?:[^"]++|"")*+"[^\t]*+(?:\t{_FIELD})*+\z')
#: Lines of a file that one task looks at together, and the most lines of one record.
LINE_BLOCK, RECORD_LINES = 4096, 100_000


def _state_before(df: DataFrame, by: list[str], order: str, settles: Column, value: Column, swaps: Column):
    """The quote state before every row, composed of all rows before it in ``by``.

    A row either settles the state (``value``, whatever it was), swaps it or keeps
    it.  So the state before a row is the last settled one, swapped as often as rows
    since then say.  Returns the table with ``__s`` (swaps before) and ``__c`` (last
    settled value and the swaps before it, or null), and the state as a function of
    the one ``by`` began with.
    """
    before = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("__s", F.coalesce(F.sum(swaps.cast("int")).over(before), F.lit(0)))
    settled = F.when(settles, F.struct(value.alias("v"), F.col("__s").alias("s")))
    df = df.withColumn("__c", F.last(settled, ignorenulls=True).over(before))
    return df, lambda start: F.pmod(F.coalesce(F.col("__c.v"), start) + F.col("__s") - F.coalesce(F.col("__c.s"), F.lit(0)), F.lit(2))


def tsv_records(spark: SparkSession, path: str, block: int = LINE_BLOCK, record_lines: int = RECORD_LINES) -> DataFrame:
    """Files -> (file, line_no, record): quoted records put together from a split read.

    Files are split like any text input.  Whether a line begins inside quotes hangs on
    all lines before it; each line is a function of two states, so functions are
    composed inside blocks of ``block`` lines, and then over the blocks of a file (one
    small row per block).  Only lines of records with several lines are shuffled to
    their record, whose ``line_no`` is that of its first line.

    Empty lines between records are left out, those inside quotes stay.  An unclosed
    quote runs to the end of its file.  A record of more than ``record_lines`` lines
    is an error that names the place: it would be gathered in one task, and is an
    unclosed quote as a rule.  Lines end in ``\\n`` or ``\\r\\n``; in a record that
    ends in the latter, those inside quotes become ``\\n`` too.
    """
    lines = _ranked_lines(spark, path, lineSep="\n")
    line = F.when(F.col("line_no") == 0, F.regexp_replace("line", "\\A\ufeff", "")).otherwise(F.col("line"))
    end = [(~F.rlike(line, F.lit(rule))).cast("int") for rule in _ENDS_OUTSIDE]
    lines = lines.select("file", "line_no", line.alias("line"), end[0].alias("e0"), end[1].alias("e1"),
                         F.floor(F.col("line_no") / block).alias("blk"))
    e0, e1 = F.col("e0"), F.col("e1")
    lines, state = _state_before(lines, ["file", "blk"], "line_no", e0 == e1, e0, e0 > e1)

    first = [F.max(F.when(state(F.lit(x)) == 0, F.col("line_no"))).alias(f"r{x}") for x in (0, 1)]
    blocks = lines.groupBy("file", "blk").agg(
        F.sum((e0 > e1).cast("int")).alias("n"),
        F.max(F.when(e0 == e1, F.struct("line_no", e0.alias("v"), F.col("__s").alias("s")))).alias("c"), *first)
    out = F.pmod(F.col("c.v") + F.col("n") - F.col("c.s"), F.lit(2))
    blocks, block_state = _state_before(blocks, ["file"], "blk", F.col("c").isNotNull(), out,
                                        F.col("c").isNull() & (F.col("n") % 2 == 1))
    blocks = blocks.withColumn("begins", block_state(F.lit(0)))
    before = Window.partitionBy("file").orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
    start = F.when(F.col("begins") == 0, F.col("r0")).otherwise(F.col("r1"))
    blocks = blocks.select("file", "blk", "begins", F.last(start, ignorenulls=True).over(before).alias("carried"))

    lines = lines.join(blocks, ["file", "blk"]).withColumn("state", state(F.col("begins")))
    ends = F.when(F.col("state") == 0, e0).otherwise(e1)
    upto = Window.partitionBy("file", "blk").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    begun = F.coalesce(F.last(F.when(F.col("state") == 0, F.col("line_no")), ignorenulls=True).over(upto), F.col("carried"))
    lines = lines.select("file", "line_no", "line", begun.alias("first"), (F.col("state") + ends == 0).alias("single"))
    single = lines.where("single").select("file", "line_no", F.col("line").alias("record"))
    place = F.concat(F.lit("a record of more than "), F.lit(str(record_lines)), F.lit(" lines (an unclosed quote?) begins at line "),
                     F.col("first").cast("string"), F.lit(" of "), F.col("file"))
    part = F.when(F.col("line_no") - F.col("first") >= record_lines, F.raise_error(place)).otherwise(F.col("line"))
    parts = lines.where("not single").groupBy("file", F.col("first").alias("line_no")).agg(
        F.array_sort(F.collect_list(F.struct("line_no", part.alias("line")))).alias("parts"))
    several = parts.select("file", "line_no", F.array_join("parts.line", "\n").alias("record"))
    record = F.when(F.col("record").endswith("\r"), F.regexp_replace("record", r"\r(\n|\z)", "$1")).otherwise(F.col("record"))
    records = single.unionByName(several).withColumn("record", record)
    return records.where(F.col("record") != "")


def read_tsv(spark: SparkSession, path: str, columns: Sequence[str] | None = None,
             na_tokens: Sequence[str] = PANDAS_NA_TOKENS, multiline: bool = True, row_id: str | None = None) -> DataFrame:
    """Header TSV with quoted fields; pandas' NA words and empty fields -> NULL (SRC-01, T6).

    All columns are read as strings (no schema inference pass over the data);
    ``columns`` selects and orders them.  ``multiline`` honours quoted newlines like
    pandas; the file is split all the same (:func:`tsv_records`).  Records are not
    in file order then: ``row_id`` names a column of their places, 0..n-1 over the
    files by name.  Without quoted newlines, ``multiline=False`` saves the shuffles.
    Each file begins with the header; columns go by place, and missing fields are null.
    """
    from ..operators.sampling import dense_ids, line_ids
    opts = dict(_CSV_IO, multiLine="true", inferSchema="false")
    names = spark.read.options(**opts).csv(path).columns  # reads the first record
    cols = list(columns) if columns else names
    if not multiline:
        df = spark.read.options(**dict(opts, multiLine="false")).csv(path)
        df = line_ids(df, row_id) if row_id else df
    else:
        rows = tsv_records(spark, path)
        header = rows.groupBy("file").agg(F.min("line_no").alias("__head"))
        rows = rows.join(header, "file").where(F.col("line_no") > F.col("__head"))
        if row_id:
            files = header.select("file", F.row_number().over(Window.orderBy("file")).alias("__f"))
            rows = dense_ids(rows.join(files, "file"), F.col("__f"), F.col("line_no"), name="__row")
        schema = ", ".join("`" + n.replace("`", "``") + "` string" for n in names)
        parsed = F.from_csv("record", schema, dict(opts, header="false"))
        keep = [F.col("__row").alias(row_id)] if row_id else []
        df = rows.select(*keep, parsed.alias("__r")).select(*([row_id] if row_id else []), "__r.*")
    kept = [F.col(row_id)] if row_id else []
    return df.select(*kept, *[na_to_null(F.col(f"`{c}`"), na_tokens).alias(c) for c in cols])


def require_columns(df: DataFrame, required: Sequence[str], optional: Sequence[str] = ()) -> list[str]:
    """Fail fast on a missing required column; return missing optional ones (SRC-07)."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"the table has no {', '.join(map(repr, missing))}; it has {', '.join(df.columns)}")
    return [c for c in optional if c not in df.columns]


def _ranked_lines(spark: SparkSession, path: str, **options) -> DataFrame:
    """Text files -> (file, line_no, line), 0-based numbers in file order, lines as read.

    Files are split like any text input, so a large one is many tasks and never
    one row.  A file's splits are read in order inside increasing partitions and
    rows, so the reading order ranks the lines of each file
    (:func:`~rewrite_lake.operators.sampling.dense_ids`); the file's own first
    rank is taken off.
    """
    from ..operators.sampling import line_ids
    raw = spark.read.options(**options).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").alias("line"))
    ranked = line_ids(raw, "rank")
    # splits are packed into partitions by size, not by place: order them by their start
    blocks = ranked.groupBy("file", "start").agg(F.min("rank").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("file", "start", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("off"))
    joined = ranked.join(blocks, ["file", "start"])
    return joined.select("file", (F.col("rank") - F.col("first") + F.col("off")).alias("line_no"), "line")


def _numbered_lines(spark: SparkSession, path: str, **options) -> DataFrame:
    """:func:`_ranked_lines` without carriage returns at line ends."""
    return _ranked_lines(spark, path, **options).select(
        "file", F.col("line_no").cast("int").alias("line_no"), F.regexp_replace("line", r"\r\z", "").alias("line"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text files -> (file, line_no, text): each line stripped, blank lines
    dropped, original order kept in ``line_no`` (SRC-02)."""
    lines = _numbered_lines(spark, path).select("file", "line_no", ustrip(F.col("line")).alias("text"))
    return lines.where(F.col("text") != "")


def read_metrics_tree(spark: SparkSession, root: str, file_name: str = "metrics.txt") -> DataFrame:
    """Every ``metrics.txt`` below ``root`` -> (path, run, line_no, line) (SRC-03).

    The run is named after the file's folder (PRJ-20); ``path`` tells runs of
    one name apart.
    """
    lines = _numbered_lines(spark, root, recursiveFileLookup="true", pathGlobFilter=file_name)
    run = F.element_at(F.split(F.col("file"), "/"), -2)
    return lines.select(F.col("file").alias("path"), run.alias("run"), "line_no", "line")


TRAINER_STATE_SCHEMA = T.StructType([
    T.StructField("best_global_step", T.LongType()),
    T.StructField("best_metric", T.DoubleType()),
    T.StructField("best_model_checkpoint", T.StringType()),
    T.StructField("global_step", T.LongType()),
    T.StructField("log_history", T.ArrayType(T.StructType([
        T.StructField("epoch", T.DoubleType()), T.StructField("step", T.LongType()),
        T.StructField("loss", T.DoubleType()), T.StructField("grad_norm", T.DoubleType()),
        T.StructField("learning_rate", T.DoubleType()), T.StructField("eval_loss", T.DoubleType()),
        T.StructField("eval_runtime", T.DoubleType()),
        T.StructField("eval_samples_per_second", T.DoubleType()),
        T.StructField("eval_steps_per_second", T.DoubleType())]))),
])


def read_trainer_state(spark: SparkSession, path: str) -> DataFrame:
    """Trainer state JSON -> one row per history entry (SRC-04).

    Train rows and eval rows are heterogeneous; a merged nullable schema keeps
    both.  Output: ``file, best_global_step, best_metric, epoch, step, loss,
    grad_norm, learning_rate, eval_loss, eval_runtime, ...``.
    """
    df = spark.read.schema(TRAINER_STATE_SCHEMA).option("multiLine", "true").json(path)
    df = df.select(F.col("_metadata.file_path").alias("file"), "best_global_step", "best_metric",
                   F.explode("log_history").alias("h"))
    return df.select("file", "best_global_step", "best_metric", "h.*")


def read_step_logs(spark: SparkSession, path: str) -> DataFrame:
    """Run logs -> (file, line_no, line), ready for ``runs.parse_log_lines`` (SRC-05)."""
    return _numbered_lines(spark, path)


def read_run_config(path: str, override: str | dict | None = None) -> dict:
    """Small JSON run config with a shallow key override (SRC-06).

    A config is a few KB, so it is a driver-side dict; its model list becomes
    a DataFrame with :func:`config_models`.
    """
    with open(path, encoding="utf-8") as f:
        cfg = json.load(f)
    if override:
        cfg.update(json.loads(override) if isinstance(override, str) else override)
    return cfg


def config_models(spark: SparkSession, cfg: dict) -> DataFrame:
    """The config's ``models`` list as rows, in config order (``model_idx``)."""
    models = cfg.get("models") or []
    if not models:
        raise ValueError("the config lists no models")
    rows = [(i, m.get("name") or m["path"].rstrip("/").split("/")[-1], m.get("path"), m.get("batch_size"),
             json.dumps(m.get("generation") or {})) for i, m in enumerate(models)]
    return spark.createDataFrame(rows, "model_idx int, name string, path string, batch_size int, generation string")


# --- sinks ---------------------------------------------------------------------------

def write_tsv(df: DataFrame, path: str, mode: str = "overwrite", single_file: bool = False) -> None:
    """Header TSV with blanks preserved (SNK-01, T7)."""
    out = df.coalesce(1) if single_file else df
    out.write.mode(mode).options(**_CSV_IO).csv(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite", single_file: bool = False) -> None:
    """Header CSV (SNK-02): history, preview, summary tables."""
    out = df.coalesce(1) if single_file else df
    out.write.mode(mode).option("header", "true").csv(path)


def write_metrics_text(metrics: DataFrame, path: str, keys: Sequence[str], run: str | None = None,
                       mode: str = "overwrite") -> None:
    """One ``KEY: value`` line per metric (SNK-03); unpivot with ``stack``.

    With ``run`` given, output is partitioned by run (one folder per run).
    """
    stack = F.expr("stack({n}, {items})".format(
        n=len(keys), items=", ".join(f"'{k}', cast(`{k}` as double)" for k in keys))).alias("key", "value")
    long = metrics.select(*([run] if run else []), stack)
    lines = long.select(*([run] if run else []),
                        F.concat_ws(": ", F.col("key"), F.col("value").cast("string")).alias("value"))
    w = lines.write.mode(mode)
    if run:
        w = w.partitionBy(run)
    w.text(path)


def write_metrics_json(metrics: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Metrics rows as JSON lines (SNK-04)."""
    metrics.write.mode(mode).json(path)


def config_frame(spark: SparkSession, cfg: dict) -> DataFrame:
    """The effective config as a one-row DataFrame (SNK-04 frozen copy)."""
    return spark.createDataFrame([(json.dumps(cfg, sort_keys=True),)], "config string")


def write_bucketed(df: DataFrame, table_name: str, key: str, buckets: int, sort: bool = True,
                   mode: str = "overwrite") -> None:
    """Persist a table bucketed (and sorted) by ``key``.

    Documents and labels joined on ``doc_id`` would otherwise shuffle every
    document's text at each join; written with the same bucket count on the
    same key, the sort-merge join reads matching buckets side by side with no
    exchange.
    """
    w = df.write.mode(mode).format("parquet").bucketBy(buckets, key)
    if sort:
        w = w.sortBy(key)
    w.saveAsTable(table_name)
