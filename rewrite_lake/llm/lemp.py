"""Hard negatives by inner product, with LEMP-style buckets and coordinate pruning.

Rows are integer vectors.  They are sorted by (label, length descending) over the
cluster and cut into buckets; a bucket holds, for every coordinate, its rows in
the order of that coordinate's normalised value.  An anchor with a score to beat
skips a bucket whose longest row cannot reach it.  In the others the score gives
an angle, the angle a feasible range of each focus coordinate (the anchor's
largest), and the ranges in the sorted lists are intersected; only the rows in
all of them are multiplied out, exactly, in integers.  Scores to beat rise while
a task goes from bucket to bucket.

Anchors are a stated query set.  They go in blocks of at most ``BLOCK_BYTES``:
one block is broadcast, meets all buckets where they lie, and leaves its best
rows per task, which are merged by anchor.  Nothing is paired by a join.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, read, scratch

#: Rows of a bucket, buckets of a task, focus coordinates, bytes of an anchor block, scores held at once.
BUCKET, BUCKETS_A_TASK, FOCUS, BLOCK_BYTES, CELLS = 4096, 4, 3, 16 << 20, 1 << 22
#: Angles and bounds are loosened by this, so rounding loses no row.
SLACK = 1e-9

_BUCKET = "label bigint, n int, dim int, longest double, shortest double, ids binary, x binary, kind string, lists binary"
_BLOCK = "run int, no int, n int, dim int, ids binary, labels binary, x binary"


def _schema(ddl: str) -> pa.Schema:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary()}
    return pa.schema([(a, kinds[b]) for a, b in (x.split() for x in ddl.split(", "))])


def quantized(vectors: DataFrame, *, id_col: str = "vec_id", label: str | Column = "label", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """(vec_id, label, v, len2): rows as integer vectors, floor(scale * x), and their squared length.

    Rows with a null id, label or vector, or a null or non-finite component take no part.
    """
    v = F.col(vector_col)
    odd = F.exists(v, lambda x: F.coalesce(F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")), F.lit(True)))
    label = F.col(label) if isinstance(label, str) else label
    whole = vectors.where(F.col(id_col).isNotNull() & label.isNotNull() & v.isNotNull() & ~odd).select(
        F.col(id_col).cast("long").alias("vec_id"), label.cast("long").alias("label"),
        F.transform(v, lambda x: F.floor(x.cast("double") * scale)).alias("v"))
    return whole.withColumn("len2", F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def _matrix(rows: list[list[int]]) -> np.ndarray:
    """Rows of one width; shorter vectors end in zeros."""
    dim = max(map(len, rows), default=0)
    if all(len(r) == dim for r in rows):
        return np.array(rows, dtype=np.int64).reshape(len(rows), dim)
    return np.array([list(r) + [0] * (dim - len(r)) for r in rows], dtype=np.int64)


def bucket_rows(label: int, ids: list[int], rows: list[list[int]]) -> dict:
    """One bucket: its rows, and per coordinate the rows in ascending order of the normalised value."""
    x = _matrix(rows)
    least = np.min_scalar_type(-max(1, int(np.abs(x).max(initial=0)))) if x.size else np.dtype("i2")
    length = np.sqrt((x.astype(float) ** 2).sum(1))
    unit = x / np.where(length > 0, length, 1)[:, None]
    return {"label": label, "n": len(ids), "dim": x.shape[1], "longest": float(length.max()), "shortest": float(length.min()),
            "ids": np.array(ids, dtype="<i8").tobytes(), "x": x.astype(least).tobytes(), "kind": least.str,
            "lists": np.argsort(unit, axis=0, kind="stable").T.astype("<u2").tobytes()}


def buckets(rows: DataFrame, *, size: int = BUCKET, tasks: int | None = None) -> DataFrame:
    """All rows in buckets of one label, longest first; exact repeats (id, label, vector) count once."""
    if not 0 < size <= 1 << 16:
        raise ValueError("a bucket has 1 to 65536 rows")
    tasks = tasks or max(1, math.ceil(rows.count() / (size * BUCKETS_A_TASK)))
    by = [F.col("label"), F.col("len2").desc(), F.col("vec_id")]

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, held, now, before = _schema(_BUCKET), ([], []), None, None

        def flush():
            if held[0]:
                yield pa.RecordBatch.from_pylist([bucket_rows(now, *held)], schema=schema)
        for b in batches:
            for i, label, v in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (i, label, v) == before:
                    continue
                before = (i, label, v)
                if label != now or len(held[0]) >= size:
                    yield from flush()
                    held, now = ([], []), label
                held[0].append(i)
                held[1].append(v)
        yield from flush()
    dealt = rows.repartitionByRange(tasks, *by).sortWithinPartitions(*by, "v").select("vec_id", "label", "v")
    return materialize(dealt.mapInArrow(build, _BUCKET), "lemp-buckets")


def anchor_blocks(anchors: DataFrame, *, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Anchors packed in rows of at most ``block_bytes`` of vectors (one anchor at least); repeats count once."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        held, size, no, run = [], 0, 0, TaskContext.get().partitionId()

        def row():
            x = _matrix([r[2] for r in held])
            return pa.RecordBatch.from_pylist([{"run": run, "no": no, "n": len(held), "dim": x.shape[1], "ids": np.array([r[0] for r in held], "<i8").tobytes(),
                                                "labels": np.array([r[1] for r in held], "<i8").tobytes(), "x": x.astype("<i8").tobytes()}], schema=_schema(_BLOCK))
        for b in batches:
            for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held and size + 8 * len(r[2]) > block_bytes:
                    yield row()
                    held, size, no = [], 0, no + 1
                held.append(r)
                size += 8 * len(r[2])
        if held:
            yield row()
    slim = anchors.select("vec_id", "label", "v").distinct()
    n = max(1, math.ceil(anchors.count() * 8 * 64 / block_bytes))
    return materialize(slim.coalesce(n).mapInArrow(pack, _BLOCK), "lemp-anchors")


class Block:
    """Anchors in memory: ids, labels, vectors, and what pruning needs of them."""

    def __init__(self, row):
        self.ids, self.labels = np.frombuffer(bytes(row["ids"]), "<i8"), np.frombuffer(bytes(row["labels"]), "<i8")
        self.x = np.frombuffer(bytes(row["x"]), "<i8").reshape(row["n"], row["dim"])
        self.length = np.sqrt((self.x.astype(float) ** 2).sum(1))
        unit = self.x / np.where(self.length > 0, self.length, 1)[:, None]
        self.focus = np.argsort(-np.abs(unit), axis=1, kind="stable")[:, :FOCUS]
        self.alpha = np.arccos(np.clip(np.take_along_axis(unit, self.focus, axis=1), -1, 1))


class Bucket:
    def __init__(self, row: dict):
        n, dim = row["n"], row["dim"]
        self.n, self.label, self.longest, self.shortest = n, row["label"], row["longest"], row["shortest"]
        self.ids = np.frombuffer(row["ids"], "<i8")
        self.x = np.frombuffer(row["x"], row["kind"]).reshape(n, dim)
        self.lists = np.frombuffer(row["lists"], "<u2").reshape(dim, n)
        length = np.sqrt((self.x.astype(float) ** 2).sum(1))
        self.unit = self.x / np.where(length > 0, length, 1)[:, None]

    def products(self, x: np.ndarray, rows: np.ndarray | None = None) -> np.ndarray:
        """Exact inner products of anchors ``x`` with the bucket's rows (or some of them)."""
        mine = self.x if rows is None else self.x[rows]
        dim = max(x.shape[1], mine.shape[1])
        pad = lambda m: np.pad(m, ((0, 0), (0, dim - m.shape[1]))) if m.shape[1] < dim else m
        x, mine = pad(x), pad(mine)
        bound = dim * int(np.abs(x).max(initial=0)) * int(np.abs(mine.astype(np.int64)).max(initial=0))
        if bound < 1 << 53:  # sums of whole numbers that doubles hold exactly
            return (x.astype(float) @ mine.astype(float).T).astype(np.int64)
        if bound >= 1 << 63:
            raise ValueError("scores of these vectors do not fit a long")
        return x.astype(np.int64) @ mine.astype(np.int64).T

    def feasible(self, block: Block, who: np.ndarray, least: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
        """(anchors, rows): the rows of each anchor in ``who`` that may score ``least`` or more.

        Anchors whose ranges leave most rows come together, with rows None for all.
        """
        reach = np.where(least > 0, self.longest, self.shortest) * block.length[who]
        cosine = np.divide(least, reach, out=np.where(least > 0, np.inf, -1.0), where=reach > 0) - SLACK
        live = cosine <= 1
        who, gamma = who[live], np.arccos(np.clip(cosine[live], -1, 1))[:, None]
        if not len(who):
            return
        alpha, focus = block.alpha[who], block.focus[who]
        low = np.cos(np.minimum(np.pi, alpha + gamma)) - SLACK
        high = np.cos(np.maximum(0, alpha - gamma)) + SLACK
        a, b = np.zeros(focus.shape, np.int64), np.full(focus.shape, self.n, np.int64)
        for f in np.unique(focus[focus < len(self.lists)]):
            at, values = focus == f, self.unit[self.lists[f], f]
            a[at], b[at] = np.searchsorted(values, low[at], "left"), np.searchsorted(values, high[at], "right")
        width = b - a
        few = width.min(axis=1, initial=self.n) < self.n // 4
        if (~few).any():
            yield who[~few], None
        for i in np.flatnonzero(few):
            order = np.argsort(width[i], kind="stable")
            rows = self.lists[focus[i, order[0]], a[i, order[0]]:b[i, order[0]]].astype(np.int64)
            for j in order[1:]:
                if focus[i, j] < len(self.lists):
                    value = self.unit[rows, focus[i, j]]
                    rows = rows[(value >= low[i, j]) & (value <= high[i, j])]
            if len(rows):
                yield who[i:i + 1], rows


class Best:
    """The ``k`` best (score, least id) of each of many queries, updated in bulk."""

    def __init__(self, n: int, k: int):
        self.k, self.query, self.score, self.id = k, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.floor = np.full(n, np.iinfo(np.int64).min)

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(query):
            return
        q, s, i = np.concatenate([self.query, query]), np.concatenate([self.score, score]), np.concatenate([self.id, ids])
        order = np.lexsort((i, -s, q))
        q, s, i = q[order], s[order], i[order]
        first = np.searchsorted(q, q)
        rank = np.arange(len(q)) - first
        keep = rank < self.k
        self.query, self.score, self.id = q[keep], s[keep], i[keep]
        full = rank == self.k - 1
        self.floor[q[full]] = s[full]


def _offer(best: Best, query: np.ndarray, scores: np.ndarray, fits: np.ndarray, ids: np.ndarray) -> None:
    """Hand over the scores of ``query`` x rows that fit, at least each query's floor."""
    fits &= scores >= best.floor[query][:, None]
    many = np.flatnonzero(fits.sum(axis=1) > 4 * best.k)
    if len(many):  # only those from each query's k-th best on
        some = np.where(fits[many], scores[many], np.iinfo(np.int64).min)
        fits[many] &= scores[many] >= np.partition(some, -best.k, axis=1)[:, -best.k][:, None]
    r, c = np.nonzero(fits)
    best.add(query[r], scores[r, c], ids[c])


def _scan(block: Block, n_queries: int, k: int, visit) -> callable:
    """A task's work: ``visit(bucket, best)`` for each bucket, then its best rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(n_queries, k)
        for b in batches:
            for row in b.to_pylist():
                visit(Bucket(row), best)
        if len(best.query):
            yield pa.RecordBatch.from_arrays([pa.array(best.query), pa.array(best.score), pa.array(best.id)], ["q", "score", "id"])
    return run


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best rows per query of what the tasks kept."""
    w = Window.partitionBy("q").orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _find(index: DataFrame, block: Block, n_queries: int, k: int, visit) -> DataFrame:
    sent = index.sparkSession.sparkContext.broadcast((block, visit))

    def run(batches):
        block, visit = sent.value
        return _scan(block, n_queries, k, visit)(batches)
    return _ranked(index.mapInArrow(run, "q bigint, score bigint, id bigint"), k)


class Nearest:
    """Best rows of the anchor's own label, other ids."""

    def __init__(self, block: Block):
        self.block = block

    def __call__(self, bucket: Bucket, best: Best) -> None:
        who = np.flatnonzero(self.block.labels == bucket.label)
        for who, rows in list(bucket.feasible(self.block, who, best.floor[who].astype(float))):
            for at in range(0, len(who), max(1, CELLS // bucket.n)):
                some = who[at:at + max(1, CELLS // bucket.n)]
                ids = bucket.ids if rows is None else bucket.ids[rows]
                scores = bucket.products(self.block.x[some], rows)
                _offer(best, some, scores, ids[None, :] != self.block.ids[some][:, None], ids)


class Between:
    """Best rows of other labels with a score from ``low`` to ``high``; one query per (anchor, positive)."""

    def __init__(self, block: Block, anchor: np.ndarray, low: np.ndarray, high: np.ndarray):
        self.block, self.anchor, self.low, self.high = block, anchor, low, high

    def __call__(self, bucket: Bucket, best: Best) -> None:
        open_ = (self.block.labels[self.anchor] != bucket.label) & (self.low <= self.high)
        need = np.full(len(self.block.ids), np.inf)
        np.minimum.at(need, self.anchor[open_], np.maximum(self.low, best.floor)[open_])
        first = np.searchsorted(self.anchor, np.arange(len(self.block.ids) + 1))
        who = np.flatnonzero(np.isfinite(need))
        for who, rows in list(bucket.feasible(self.block, who, need[who])):
            for at in range(0, len(who), max(1, CELLS // bucket.n)):
                some = who[at:at + max(1, CELLS // bucket.n)]
                ids = bucket.ids if rows is None else bucket.ids[rows]
                scores = bucket.products(self.block.x[some], rows)
                for j in range(int((first[some + 1] - first[some]).max())):  # the j-th positive of each anchor
                    has = np.flatnonzero(first[some] + j < first[some + 1])
                    query = first[some[has]] + j
                    mine = scores[has]
                    _offer(best, query, mine, (mine >= self.low[query][:, None]) & (mine <= self.high[query][:, None]) & open_[query][:, None], ids)


def bounds(score: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """The whole scores s with low * score <= 100 * s <= high * score."""
    def floor(p):  # floor(p * score / 100) without a large product
        return score // 100 * p + score % 100 * p // 100
    return -((-score) // 100 * low + (-score) % 100 * low // 100), floor(high)


def mine(rows: DataFrame, anchors: DataFrame, *, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
         size: int = BUCKET, tasks: int | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Hard negatives: (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``rows`` and ``anchors`` are as :func:`quantized` gives them.  An anchor's
    positives are its ``positives`` best rows of the same label and another id; for
    each, the ``negatives`` best rows of other labels that score ``low`` to ``high``
    per cent of the positive's score.  Ties go to the smaller id.  Exact repeats
    count once; rows that share an id but not the vector are rows of their own.
    A shorter vector ends in zeros.  Empty tables give no rows.  Scores that do not
    fit a long are an error.
    """
    spark = rows.sparkSession
    index = buckets(rows, size=size, tasks=tasks)
    blocks = anchor_blocks(anchors, block_bytes=block_bytes)
    path = scratch(spark, "lemp")
    schema = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    spark.createDataFrame([], schema).write.parquet(path)
    for r in blocks.select("run", "no").collect():  # a few numbers per block
        block = Block(blocks.where((F.col("run") == r["run"]) & (F.col("no") == r["no"])).collect()[0])
        near = materialize(_find(index, block, len(block.ids), positives, Nearest(block)), "lemp-positives")
        found = near.toPandas().sort_values(["q", "rank"], ignore_index=True)  # at most `positives` per anchor of the block
        anchor, score = found["q"].to_numpy(np.int64), found["score"].to_numpy(np.int64)
        pairs = spark.sparkContext.broadcast((block.ids[anchor], found["id"].to_numpy(np.int64), score))
        least, most = bounds(score, low, high)
        hard = _find(index, block, len(anchor), negatives, Between(block, anchor, least, most))

        def named(batches: Iterator[pa.RecordBatch], pairs=pairs) -> Iterator[pa.RecordBatch]:
            ids, positive, score = pairs.value
            for b in batches:
                q = np.asarray(b.column(0))
                yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(positive[q]), b.column(1), b.column(2), pa.array(score[q]), b.column(3)],
                                                 [c.split()[0] for c in schema.split(", ")])
        hard.select("q", F.col("rank").cast("int"), "id", "score").mapInArrow(named, schema).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


def op13_hard_negatives(spark, sf_dir):
    table = read(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = quantized(table, label=label)
    return mine(rows, rows.where("vec_id % 50 = 0"))


QUERIES = {"op13_hard_negatives": op13_hard_negatives}
ORACLE = {"op13_hard_negatives": r"""
with r as (
  select distinct vec_id, (case when vec_id % 7 = 0 then (label + 1) % 10 else label end)::bigint as label,
    list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v
  from embeddings
  where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select a.vec_id as anchor_id, a.label as anchor_label, b.vec_id as id, b.label,
    list_inner_product(a.v::double[], b.v::double[])::bigint as score
  from r a, r b where a.vec_id % 50 = 0),
p as (
  select anchor_id, id as positive_id, score as positive_score from s where label = anchor_label and id <> anchor_id
  qualify row_number() over (partition by anchor_id order by score desc, id) <= 5),
n as (
  select p.anchor_id, p.positive_id, s.id as negative_id, p.positive_score, s.score as negative_score,
    row_number() over (partition by p.anchor_id, p.positive_id order by s.score desc, s.id)::int as rank
  from p join s on s.anchor_id = p.anchor_id and s.label <> s.anchor_label
    and 50 * p.positive_score <= 100 * s.score and 100 * s.score <= 95 * p.positive_score)
select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from n where rank <= 3
"""}
