"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java class of the word separators (space, tab to carriage return).
BLANK = r"[\x20\x09-\x0D]+"
#: A word: a maximal run of anything else.
WORD = r"[^\x20\x09-\x0D]+"
_SCRATCH: list[str] = []


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, read through Spark whatever the store."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Unset, a local session gets a scratch folder (tests); on a cluster it is an
    error, since a machine-local folder would lose data with its executor.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        path = current.get() if current.isDefined() else None
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="llm-shared-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, which :func:`release` removes."""
    path = f"{shared_dir(spark)}/llm-{name}-{uuid.uuid4().hex}"
    _SCRATCH.append(path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, so
    a lost executor costs a re-read, and an input used twice is computed once."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Delete what this driver's operators wrote to the shared folder so far; how many paths.

    Call it once results are stored: DataFrames that still read those paths fail."""
    n = 0
    while _SCRATCH:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_SCRATCH.pop())
        n += path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return n


def fresh(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with underscores added until no column of ``df`` clashes
    (Spark resolves names without regard to case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """The words of a text; null and blank texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANK), "")


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def running_sum(values: Column) -> Column:
    """Inclusive prefix sums of an array, by doubling: O(n log n) in all, and no
    array grows by one element at a time."""
    steps = F.filter(F.array(*[F.lit(1 << i) for i in range(31)]), lambda d: d < F.size(values))
    return F.aggregate(
        steps, values,
        lambda acc, d: F.transform(acc, lambda v, i: v + F.coalesce(F.get(acc, i - d), F.lit(0).cast("long"))))


def components(edges: DataFrame, name: str, src: str = "a", dst: str = "b", max_rounds: int = 60) -> DataFrame:
    """Connected components of an edge table: (node, root), root the least node.

    Each round hooks every node to the least label around it and then jumps
    along the labels; it stops when nothing changes.  Only nodes that have an
    edge take part, and a star's hot centre is summed up map-side.
    """
    both = edges.select(F.col(src).alias("u"), F.col(dst).alias("v"))
    both = materialize(both.union(both.select("v", "u")).where("u <> v").distinct(), f"{name}-edges")
    labels = materialize(both.groupBy("u").agg(F.min("v").alias("m"))
                         .select(F.col("u").alias("node"), F.least("u", "m").alias("root")), f"{name}-0")
    for i in range(1, max_rounds):
        near = both.join(labels.withColumnRenamed("node", "v"), "v").groupBy("u").agg(F.min("root").alias("m"))
        hooked = labels.join(near, F.col("node") == F.col("u")).select(
            "node", "root", F.least("root", "m").alias("next"))
        # the old root learns the new label too, so whole trees merge at once
        best = hooked.select(F.col("root").alias("r"), "next").groupBy("r").agg(F.min("next").alias("best"))
        pushed = hooked.join(best, F.col("next") == F.col("r"), "left").select(
            "node", "root", F.least("next", F.coalesce("best", "next")).alias("next"))
        new = materialize(pushed.select("node", F.col("next").alias("root"), (F.col("root") != F.col("next")).alias("moved")),
                          f"{name}-{i}")
        labels = new.select("node", "root")
        if new.where("moved").isEmpty():
            return labels
    raise RuntimeError("components did not settle")
