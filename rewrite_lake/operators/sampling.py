"""Sampling, splitting, batching and dense ids (SMP-01..08).

No Spark sampler reproduces numpy's Mersenne draws; the contract is *exact
sizes, reproducible by seed*: a row's random key is ``md5(seed|id...)``, which
DuckDB can compute too.

Exact global ranks (split sizes, batches, dense ids) never rank all rows in
one window.  :func:`global_rank` cuts the key space into ``P``
deterministic buckets, counts rows per bucket (a partial aggregate -> P rows),
turns the counts into offsets (P rows, broadcast: bounded by P, not by the
data) and ranks inside each bucket with a window partitioned by bucket.
md5 keys are uniform, so buckets are even no matter how skewed the ids are;
recomputation after an executor loss gives identical buckets.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HEX_DIGITS = 8  # bucket on the first 32 bits of the md5 key


def _cols(ids) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in ([ids] if isinstance(ids, (str, Column)) else ids)]


def _order(ids) -> list[Column]:
    """Ascending sort order of ids, nulls last (as in the SQL)."""
    return [c.asc_nulls_last() for c in _cols(ids)]


def random_key(seed: int, ids) -> Column:
    """``md5(seed|id1|id2...)``: a uniform, reproducible sort key."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[c.cast("string") for c in _cols(ids)]))


def head(df: DataFrame, n: int, order) -> DataFrame:
    """First ``n`` rows by ``order`` (SMP-01); a per-partition top-n heap."""
    by = [F.col(c).asc_nulls_last() if isinstance(c, str) else c
          for c in ([order] if isinstance(order, (str, Column)) else order)]
    return df.orderBy(*by).limit(int(n))


#: Buckets of keys that a sample is chosen by.
SAMPLE_BUCKETS = 1 << 16


def sample_capped(df: DataFrame, n: int, seed: int, ids, buckets: int = SAMPLE_BUCKETS) -> DataFrame:
    """``min(n, rows)`` rows without replacement, reproducible (SMP-03): those with the least keys.

    No task sees the sample: rows are counted in ``buckets`` ranges of the key, the
    ranges' running counts say which are taken whole and which one is parted, and
    only the rows of that one are ranked.  Rows with equal keys (repeated ids) go by id.
    """
    key = random_key(seed, ids)
    prefix = F.conv(F.substring(F.col("__key"), 1, HEX_DIGITS), 16, 10).cast("bigint")
    tmp = df.withColumn("__key", key).withColumn("__b", F.floor(prefix * F.lit(buckets) / F.lit(float(16 ** HEX_DIGITS))).cast("int"))
    counts = tmp.groupBy("__b").agg(F.count(F.lit(1)).alias("__n"))
    upto = F.sum("__n").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    taken = counts.select("__b", "__n", upto.alias("__upto")).where(F.col("__upto") - F.col("__n") < int(n))
    rows = tmp.join(F.broadcast(taken), "__b")  # at most ``buckets`` rows
    whole = rows.where(F.col("__upto") <= int(n))
    place = F.row_number().over(Window.partitionBy("__b").orderBy("__key", *_order(ids)))
    parted = rows.where(F.col("__upto") > int(n)).withColumn("__at", place)
    parted = parted.where(F.col("__at") <= F.lit(int(n)) - (F.col("__upto") - F.col("__n"))).drop("__at")
    return whole.unionByName(parted).drop("__key", "__b", "__n", "__upto")


def sample_exact(df: DataFrame, n: int, seed: int, ids) -> DataFrame:
    """Exactly ``n`` rows; asking for more rows than exist is an error (SMP-02, T18)."""
    total = df.count()
    if n > total:
        raise ValueError(f"Cannot take a larger sample ({n}) than population ({total}) without replacement")
    return sample_capped(df, n, seed, ids)


def _bucket_count(df: DataFrame, buckets: int | None) -> int:
    if buckets:
        return int(buckets)
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def global_rank(df: DataFrame, key: Column, tie: Sequence[Column] = (), buckets: int | None = None,
                rank_col: str = "rank", total_col: str | None = "total", by: Sequence[str] = ()) -> DataFrame:
    """0-based rank of every row by ``(key, *tie)``, plus the row count, over all
    rows or per ``by`` (few values).

    ``key`` is a lower-case hex digest (md5); rows are bucketed by its leading 32
    bits and ranked inside their bucket.
    """
    p = _bucket_count(df, buckets)
    by = list(by)
    prefix = F.conv(F.substring(F.col("__k"), 1, HEX_DIGITS), 16, 10).cast("bigint")
    tmp = df.withColumn("__k", key).withColumn(
        "__b", F.floor(prefix * F.lit(p) / F.lit(float(16 ** HEX_DIGITS))).cast("int"))
    counts = tmp.groupBy(*by, "__b").agg(F.count(F.lit(1)).alias("__n"))
    every = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    upto = every.orderBy("__b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offsets = counts.select(*by, "__b", (F.sum("__n").over(upto) - F.col("__n")).alias("__off"),
                            F.sum("__n").over(every).alias("__total"))
    w = Window.partitionBy(*by, "__b").orderBy(F.col("__k"), *tie)
    ranked = tmp.withColumn("__rn", F.row_number().over(w))
    # offsets: a row per bucket (and value of ``by``), a bound set by the bucket count
    out = ranked.join(F.broadcast(offsets), [*by, "__b"]).withColumn(
        rank_col, (F.col("__off") + F.col("__rn") - 1).cast("bigint"))
    if total_col:
        out = out.withColumn(total_col, F.col("__total").cast("bigint"))
    return out.drop("__k", "__b", "__rn", "__off", "__total")


def split_sizes(n: int, test_frac: float = 0.2, val_of_temp: float = 0.5) -> tuple[int, int, int]:
    """(train, validation, test) sizes: ``ceil`` for each held-out part (T17)."""
    n_temp = math.ceil(test_frac * n)
    n_test = math.ceil(val_of_temp * n_temp)
    return n - n_temp, n_temp - n_test, n_test


def split_exact(df: DataFrame, seed: int, ids, test_frac: float = 0.2, val_of_temp: float = 0.5,
                buckets: int | None = None) -> DataFrame:
    """80/10/10 split with exact ``ceil`` sizes (SMP-04): adds ``split``.

    Rows ordered by the seeded key: the first ``n_train`` are train, the next
    ``n_val`` validation, the rest test.  Per *pair*, not per source (T17).
    """
    ranked = global_rank(df, random_key(seed, ids), tie=_order(ids), buckets=buckets)
    n = F.col("total").cast("double")
    n_temp = F.ceil(F.lit(test_frac) * n)
    n_test = F.ceil(F.lit(val_of_temp) * n_temp)
    n_train = F.col("total") - n_temp
    n_val = n_temp - n_test
    split = (F.when(F.col("rank") < n_train, F.lit("train"))
             .when(F.col("rank") < n_train + n_val, F.lit("validation"))
             .otherwise(F.lit("test")))
    return ranked.withColumn("split", split).drop("total")


def split_hash(df: DataFrame, seed: int, ids, fractions=(0.8, 0.1, 0.1)) -> DataFrame:
    """Approximate split without any shuffle: bucket on the seeded key."""
    u = F.conv(F.substring(random_key(seed, ids), 1, HEX_DIGITS), 16, 10).cast("double") / float(16 ** HEX_DIGITS)
    a, b = fractions[0], fractions[0] + fractions[1]
    return df.withColumn("split", F.when(u < a, "train").when(u < b, "validation").otherwise("test"))


def batch_assign(df: DataFrame, batch_size: int, seed: int, ids, buckets: int | None = None) -> DataFrame:
    """Shuffled batches of ``batch_size`` (SMP-05): ``batch_id``, ``batch_pos``."""
    ranked = global_rank(df, random_key(seed, ids), tie=_order(ids), buckets=buckets, total_col="n_rows")
    return ranked.withColumn("batch_id", F.floor(F.col("rank") / F.lit(batch_size)).cast("bigint")) \
                 .withColumn("batch_pos", (F.col("rank") % F.lit(batch_size)).cast("int"))


def batch_cycle(df: DataFrame, batch_size: int, seed: int, ids, passes: int | None = None,
                steps: int | None = None, buckets: int | None = None) -> DataFrame:
    """Cyclic step schedule (SMP-06): the loader restarts when exhausted.

    Pass ``p`` reshuffles with seed ``seed + p``; step ``s`` (1-based) of the
    whole run is batch ``(s - 1) mod n_batches`` of its pass.  ``passes`` says how
    many whole passes, or ``steps`` how many steps (the last pass may be cut; this
    counts the rows first).  Rows are ranked once for all passes, on the ids and
    the pass; pass only ids, and join texts to the schedule.
    """
    if (passes is None) == (steps is None):
        raise ValueError("give either passes or steps")
    if passes is None:
        per_pass = math.ceil(df.count() / batch_size)
        passes = math.ceil(steps / per_pass) if per_pass else 0
    each = df.withColumn("pass_no", F.explode(F.sequence(F.lit(0), F.lit(passes - 1)) if passes else F.array().cast("array<int>")))
    key = F.md5(F.concat_ws("|", (F.lit(seed) + F.col("pass_no")).cast("string"), *[c.cast("string") for c in _cols(ids)]))
    b = global_rank(each, key, tie=_order(ids), buckets=buckets, total_col="n_rows", by=["pass_no"])
    b = b.withColumn("batch_id", F.floor(F.col("rank") / F.lit(batch_size)).cast("bigint")) \
         .withColumn("batch_pos", (F.col("rank") % F.lit(batch_size)).cast("int"))
    n_batches = F.ceil(F.col("n_rows") / F.lit(batch_size)).cast("bigint")
    b = b.withColumn("step", (F.col("pass_no") * n_batches + F.col("batch_id") + 1).cast("bigint"))
    return b.where(F.col("step") <= steps) if steps is not None else b


def dense_ids(df: DataFrame, major: Column, minor: Column, tie: Sequence[Column] = (),
              name: str = "row_id", span: int = 4096, block: int = 65536) -> DataFrame:
    """0..n-1 in the order of (major, minor, *tie), whole numbers (SMP-08).

    No window and no action sees all rows: rows are counted per block of one
    ``major`` and ``block`` consecutive ``minor``, block offsets are added up
    inside a run of ``span`` majors, and only the runs' totals (one row for each
    ``span`` majors) are added up in one task.  Joins put the offsets back on the rows,
    which are ranked inside their block.  Null majors and minors come last; a key
    in a struct is equal to its like when it is null too.
    """
    tmp = df.withColumn("__a", major.cast("bigint")).withColumn("__m", minor.cast("bigint"))
    tmp = tmp.withColumn("__b", F.floor(F.col("__m") / block)).withColumn("__s", F.floor(F.col("__a") / span))
    tmp = tmp.withColumn("__k", F.struct("__a", "__b"))
    blocks = tmp.groupBy("__s", "__a", "__b").agg(F.count(F.lit(1)).alias("__n"))
    upto = [Window.unboundedPreceding, -1]
    runs = blocks.groupBy("__s").agg(F.sum("__n").alias("__t")).select(
        "__s", F.coalesce(F.sum("__t").over(Window.orderBy(*_order("__s")).rowsBetween(*upto)), F.lit(0)).alias("__base"))
    inside = Window.partitionBy("__s").orderBy(*_order(["__a", "__b"])).rowsBetween(*upto)
    offsets = blocks.select("__s", "__a", "__b", F.coalesce(F.sum("__n").over(inside), F.lit(0)).alias("__off"))
    runs = runs.withColumnRenamed("__s", "__run")
    offsets = offsets.join(runs, F.col("__s").eqNullSafe(F.col("__run"))).select(
        F.struct("__a", "__b").alias("__k"), (F.col("__base") + F.col("__off")).alias("__off"))
    rank = F.row_number().over(Window.partitionBy("__k").orderBy("__m", *tie))
    out = tmp.withColumn("__r", rank).join(offsets, "__k")
    return out.withColumn(name, (F.col("__off") + F.col("__r") - 1).cast("bigint")).drop("__a", "__m", "__b", "__s", "__k", "__r", "__off")


def line_ids(df: DataFrame, name: str = "row_id") -> DataFrame:
    """0..n-1 in the order the rows were read: partition, then place in it."""
    tmp = df.withColumn("__id", F.monotonically_increasing_id())
    return dense_ids(tmp, F.shiftright("__id", 33), F.col("__id").bitwiseAND(F.lit((1 << 33) - 1)), name=name).drop("__id")


def lead_in_blocks(df: DataFrame, partition: str, order: str, value: str, offsets: dict[int, str],
                   block: int = 4096) -> DataFrame:
    """``lead(value, k) over (partition by p order by o nulls last)`` for each ``k -> name``.

    Rows are dealt by (p, floor(o / block)), so a huge ``p`` is many tasks; those
    without an order come last, in blocks of values that begin with the same two
    bytes.  What a block's last rows
    miss are the first ``max(k)`` rows of the blocks after it, however far away:
    a table with one row per block, ordered in one task per ``p`` and joined back.
    ``o`` is a whole number with gaps of any size; rows of one ``o``, and those
    without, go by value (null last).
    """
    most = max(offsets)
    head = F.conv(F.rpad(F.hex(F.substring(F.col(value).cast("binary"), 1, 2)), 4, "0"), 16, 10).cast("bigint")
    at = F.coalesce(F.floor(F.col(order) / block).cast("bigint"), F.lit(1 << 62) + F.coalesce(head, F.lit(1 << 16)))
    # a struct of a null is equal to its like, so null partitions are joined without another shuffle
    dealt = df.withColumn("__p", F.struct(partition)).withColumn("__blk", at)
    w = Window.partitionBy("__p", "__blk").orderBy(*_order([order, value]))
    first = dealt.select("__p", "__blk", order, value).withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= most)
    first = first.groupBy("__p", "__blk").agg(F.sort_array(F.collect_list(F.struct("__rn", F.col(value).alias("v")))).alias("__first"))
    later = Window.partitionBy("__p").orderBy("__blk").rowsBetween(1, most)  # a block has one row at least
    after = first.select("__p", "__blk", F.flatten(F.collect_list("__first").over(later)).alias("__after")).where(F.size("__after") > 0)
    out = dealt.select("*", F.count(F.lit(1)).over(w.rowsBetween(1, most)).alias("__left"),
                       *[F.lead(value, k).over(w).alias(name) for k, name in offsets.items()])
    out = out.join(after, ["__p", "__blk"], "left")
    for k, name in offsets.items():
        rest = F.get("__after", (F.lit(k - 1) - F.col("__left")).cast("int"))["v"]
        out = out.withColumn(name, F.when(F.col("__left") >= k, F.col(name)).otherwise(rest))
    return out.drop("__p", "__blk", "__left", "__after")
