"""Mixing sources to target weights by Pareto order sampling.

Every source gets a word target: its weight's share of all words, capped at
``cap`` times its own words, the excess shared out again by weight until no
source is above its cap.  A document's expected copies are the source's target
over the source's words; their whole part is taken for certain, and the rest by
Pareto order sampling: documents are ranked by random odds over inclusion odds,
``(u / (1 - u)) / (p / (1 - p))``, and taken in that order while their words fit
in what is still wanted; the gap left is filled, in the same order, by documents
that fit in it, and closed by one that comes nearest.  ``p`` differs from source to source, and inside one when
``weight_col`` names a column.

No source is ranked in one task: the rank key is cut into buckets, bucket sums
are added up per source, and only the order inside a bucket is sorted.  What
comes back is one threshold per source, which every document is held against,
so texts are never shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, materialize, n_words, read

WEIGHTS = (5, 2, 1)
CAP = 3
SEED = "mix-1"
#: Buckets of the rank key; a bucket holds about this share of a source's documents.
BUCKETS = 4096
#: With weights, the quantiles of a source's odds that cut its buckets.
QUANTILES = 512
#: A source's rows are dealt over so many tasks where they meet its plan.
SALTS = 64


def source_targets(sizes: DataFrame, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source, size) rows -> source, source_size, target, by water-filling.

    One row per source remains after the aggregate; the windows run over those.
    """
    src = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    src = src.withColumn("w", F.element_at(
        F.array(*[F.lit(x) for x in weights]),
        ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")).cast("long"))
    src = src.withColumn("limit", F.col("source_size") * cap)
    # the sources that hit their cap first come first
    fill = Window.orderBy((F.col("limit").cast("double") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    upto = fill.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    src = src.select(
        "*", F.row_number().over(fill).alias("pos"),
        (F.sum("source_size").over(every) - F.coalesce(F.sum("limit").over(upto), F.lit(0))).alias("left"),
        (F.sum("w").over(every) - F.coalesce(F.sum("w").over(upto), F.lit(0))).alias("w_left"))
    src = src.withColumn("level", F.col("left").cast("double") / F.col("w_left").cast("double"))
    fits = F.col("level") * F.col("w") <= F.col("limit")
    src = src.withColumn("final", F.min(F.when(fits, F.struct("pos", "level"))).over(every)["level"])
    return src.select("source", "source_size",
                      F.least(F.col("limit").cast("double"), F.col("final") * F.col("w")).alias("target"))


def with_source(rows: DataFrame, plan: DataFrame, source: str, salt: str) -> DataFrame:
    """``rows`` with the columns of their source's plan row (key column ``s``).

    A hot source is dealt over SALTS tasks: the plan's row is there in each.
    """
    dealt = plan.withColumn("salt_", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.withColumn("_salt", F.pmod(F.xxhash64(salt), F.lit(SALTS)).cast("int"))
    return rows.join(dealt, (F.col("_salt") == F.col("salt_")) & F.col(source).eqNullSafe(F.col("s"))).drop("s", "_salt", "salt_")


def _behind(last: str, q: str = "q", key: str = "key", size: str = "size"):
    """Whether a row comes after a source's last chosen one (null: none was)."""
    return F.coalesce(F.struct(F.col(q).alias("q"), F.col(key).alias("key"), F.col(size).alias("size")) > F.col(last), F.lit(True))


def _in_order(rows: DataFrame, wanted: DataFrame, name: str, nearest: bool = False) -> DataFrame:
    """(s, last, gap) per row of ``wanted`` (s, rest): the last row of a source in
    the order (q, key, size) up to which the words fit in ``rest``, or come
    nearest to it, and what is left of ``rest`` then."""
    sums = rows.groupBy("source", "bucket").agg(F.sum("words").alias("b_size"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("*", F.coalesce(F.sum("b_size").over(before), F.lit(0)).alias("before"))
    edge = sums.join(wanted, F.col("source").eqNullSafe(F.col("s"))).where("before <= rest").select(
        "s", F.col("bucket").alias("b"), "before", "rest")
    inside = Window.partitionBy("source", "bucket").orderBy("q", "key", "size").rowsBetween(Window.unboundedPreceding, 0)
    chosen = rows.join(edge, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    chosen = chosen.select("source", "q", "key", "size", "words", "rest", (F.col("before") + F.sum("words").over(inside)).alias("upto"))
    fits = F.col("upto") - F.col("words") / 2 <= F.col("rest") if nearest else F.col("upto") <= F.col("rest")
    last = chosen.where(fits).groupBy(F.col("source").alias("t")).agg(
        F.max(F.struct("q", "key", "size")).alias("last"), F.max("upto").alias("got"))
    out = wanted.join(last, F.col("s").eqNullSafe(F.col("t")), "left")
    return materialize(out.select("s", "last", (F.col("rest") - F.coalesce("got", F.lit(0))).alias("gap")), name)


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weight_col: str | None = None, weights=WEIGHTS, cap: int = CAP, seed: str = SEED,
        buckets: int = BUCKETS) -> DataFrame:
    """``docs`` with size, source_size, target, copies and taken (copies x size).

    A null text has size 0; a null source is a source of its own, ordered last;
    a null id draws by its text.  Rows equal in id (or, where that is null, in
    text) share one draw; equal in size too, they are taken together.  An empty table gives no rows.  Added columns whose names clash with those of ``docs`` get underscores.
    ``weight_col`` scales expected copies (null or negative: 0; never above ``cap``).
    """
    size, src_size, target, copies, taken = fresh(docs, "size", "source_size", "target", "copies", "taken")
    key_c, src_c, rel_c = fresh(docs, "_key", "_source", "_rel")
    rel = F.lit(1.0) if weight_col is None else F.greatest(F.coalesce(F.col(weight_col).cast("double"), F.lit(0.0)), F.lit(0.0))
    drawn = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("t"), F.md5(F.coalesce(F.col(text_col), F.lit("")))))))
    full = docs.select("*", n_words(F.col(text_col)).alias(size), drawn.alias(key_c), F.col(source_col).alias(src_c), rel.alias(rel_c))
    slim = materialize(full.select(F.col(src_c).alias("source"), F.col(size).alias("size"), F.col(key_c).alias("key"),
                                   F.col(rel_c).alias("rel")), "mix")
    base = slim.groupBy(F.col("source").alias("s")).agg(F.sum(F.col("rel") * F.col("size")).alias("rel_size"))
    plan = source_targets(slim, weights, cap).join(base, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    plan = materialize(plan.select(
        "source", "source_size", "target",
        F.when(F.col("rel_size") > 0, F.col("target") / F.col("rel_size")).otherwise(F.lit(0.0)).alias("rate")), "mix-plan")

    def expected(frame, rel_name):
        """certain copies and the inclusion probability of one more"""
        e = F.least(F.col("rate") * F.col(rel_name), F.lit(float(cap)))
        return frame.withColumn("whole_", F.floor(e)).withColumn("p_", e - F.floor(e))

    def uniform(key):
        return (F.conv(F.substring(key, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))

    def odds(key):
        u = uniform(key)
        return F.when(F.col("p_") > 0, (u / (1 - u)) / (F.col("p_") / (1 - F.col("p_"))))

    rates = plan.select(F.col("source").alias("s"), "rate")
    ranked = expected(with_source(slim, rates, "source", "key"), "rel")
    certain = ranked.groupBy(F.col("source").alias("s")).agg(F.sum(F.col("whole_") * F.col("size")).alias("certain"))
    wanted = plan.join(certain, F.col("source").eqNullSafe(F.col("s"))).select(
        "s", (F.col("target") - F.col("certain")).alias("rest"))
    drawn_rows = ranked.where("p_ > 0 and size > 0").withColumn("q", odds(F.col("key")))
    if weight_col is None:  # one probability per source: the odds go with the draw, which is uniform
        drawn_rows = drawn_rows.withColumn("bucket", F.floor(uniform(F.col("key")) * buckets).cast("int"))
    else:
        points = min(buckets, QUANTILES)
        cuts = drawn_rows.groupBy(F.col("source").alias("s")).agg(
            F.percentile_approx("q", [i / points for i in range(1, points)] or [0.5], 20 * points).alias("cuts_"))
        drawn_rows = with_source(drawn_rows, materialize(cuts, "mix-cuts"), "source", "key").withColumn(
            "bucket", F.size(F.filter("cuts_", lambda c: c < F.col("q")))).drop("cuts_")
    drawn_rows = materialize(drawn_rows.groupBy("source", "bucket", "q", "key", "size").agg(F.sum("size").alias("words")), "mix-drawn")
    # in Pareto order while the words fit; then, in the same order, what fits in the gap; then what comes nearest
    one = _in_order(drawn_rows, wanted, "mix-1")
    rest = with_source(drawn_rows, one.withColumnRenamed("last", "last1"), "source", "key").where(_behind("last1") & (F.col("size") <= F.col("gap")))
    two = _in_order(rest.select(*drawn_rows.columns), one.select("s", F.col("gap").alias("rest")), "mix-2")
    both = one.select("s", F.col("last").alias("last1"), F.col("gap").alias("gap1")).join(
        two.select(F.col("s").alias("t"), F.col("last").alias("last2"), F.col("gap").alias("gap2")), F.col("s").eqNullSafe(F.col("t"))).drop("t")
    rest = with_source(drawn_rows, both, "source", "key").where(
        _behind("last1") & ~((F.col("size") <= F.col("gap1")) & ~_behind("last2")) & (F.col("size") <= 2 * F.col("gap2")))
    three = _in_order(rest.select(*drawn_rows.columns), both.select("s", F.col("gap2").alias("rest")), "mix-3", nearest=True)
    both = both.join(three.select(F.col("s").alias("t"), F.col("last").alias("last3")), F.col("s").eqNullSafe(F.col("t"))).drop("t")
    rules = plan.join(both, F.col("source").eqNullSafe(F.col("s")), "left").select(
        F.col("source").alias("s"), F.col("source_size").alias("source_size_"), F.col("target").alias("target_"), F.col("rate"),
        "last1", "last2", "last3", "gap1", "gap2")
    out = expected(with_source(full, rules, src_c, key_c), rel_c)
    out = out.withColumn("q_", odds(F.col(key_c)))
    upto = lambda name: ~_behind(name, "q_", key_c, size)
    one_more = (F.col("p_") > 0) & (F.col(size) > 0) & (
        upto("last1") | (upto("last2") & (F.col(size) <= F.col("gap1"))) | (upto("last3") & (F.col(size) <= 2 * F.col("gap2"))))
    n = (F.col("whole_") + one_more.cast("long")).cast("long")
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], F.col(size), F.col("source_size_").alias(src_size),
                      F.col("target_").alias(target), n.alias(copies), (n * F.col(size)).alias(taken))


def op10_pareto_mix(spark, sf_dir):
    out = mix(read(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select("doc_id", "size", "source_size", "target", "taken", "copies")


QUERIES = {"op10_pareto_mix": op10_pareto_mix}

ORACLE = {"op10_pareto_mix": r"""
with sized as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
         md5('mix-1:' || coalesce(doc_id::varchar, 't' || md5(coalesce(text, '')))) as key
  from documents),
src as (
  select source, sum(size)::bigint as source_size,
         case ((row_number() over (order by source nulls last)) - 1) % 3 when 0 then 5 when 1 then 2 else 1 end as w
  from sized group by source),
filled as (
  select *, source_size * 3 as lim,
         row_number() over f as pos,
         (sum(source_size) over () - coalesce(sum(source_size * 3) over (f rows between unbounded preceding and 1 preceding), 0))::double
         / (sum(w) over () - coalesce(sum(w) over (f rows between unbounded preceding and 1 preceding), 0))::double as level
  from src window f as (order by (source_size * 3)::double / w, source nulls last)),
lev as (select arg_min(level, pos) as final from filled where level * w <= lim),
plan as (select source, source_size, least(lim::double, final * w) as target from filled, lev),
rated as (
  select s.*, p.source_size, p.target,
         least(case when p.source_size > 0 then p.target / p.source_size::double else 0.0 end, 3.0) as e
  from sized s join plan p on s.source is not distinct from p.source),
parts as (
  select *, floor(e) as whole, e - floor(e) as p, target - sum(floor(e) * size) over (partition by source) as rest,
         (('0x' || substr(key, 1, 13))::bigint::double + 0.5) / 4503599627370496.0 as u
  from rated),
odds as (select *, case when p > 0 then (u / (1 - u)) / (p / (1 - p)) end as q from parts),
ties as (
  select source, q, key, size, sum(size) as tsize, any_value(rest) as rest from odds where p > 0 and size > 0 group by source, q, key, size),
one as (
  select *, sum(tsize) over (partition by source order by q, key, size rows unbounded preceding) as upto from ties),
one_ as (
  select source, any_value(rest) - coalesce(max(upto) filter (upto <= rest), 0) as gap1,
         coalesce(max(upto) filter (upto <= rest), 0) as got1 from one group by source),
two as (
  select o.*, g.gap1, o.upto <= g.got1 as in1,
         sum(case when o.upto > g.got1 and o.size <= g.gap1 then o.tsize else 0 end)
         over (partition by o.source order by o.q, o.key, o.size rows unbounded preceding) as upto2
  from one o join one_ g on o.source is not distinct from g.source),
two_ as (
  select *, not in1 and size <= gap1 and upto2 <= gap1 as in2 from two),
gaps as (
  select source, any_value(gap1) - coalesce(sum(tsize) filter (in2), 0) as gap2 from two_ group by source),
three as (
  select t.*, g.gap2, sum(case when not in1 and not in2 and size <= 2 * gap2 then tsize else 0 end)
         over (partition by t.source order by t.q, t.key, t.size rows unbounded preceding) as upto3
  from two_ t join gaps g on t.source is not distinct from g.source),
picked as (
  select source, q, key, size from three
  where in1 or in2 or (not in1 and not in2 and size <= 2 * gap2 and upto3 - tsize / 2.0 <= gap2))
select o.doc_id, o.size, o.source_size, o.target,
       (o.whole + case when p.key is not null then 1 else 0 end)::bigint as copies,
       ((o.whole + case when p.key is not null then 1 else 0 end) * o.size)::bigint as taken
from odds o left join picked p on o.source is not distinct from p.source and o.q = p.q and o.key = p.key and o.size = p.size
"""}
