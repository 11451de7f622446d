"""Hard negatives against brute force; pruning that prunes."""
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rewrite_lake.llm import lemp as L

SCHEMA = "vec_id bigint, label int, embedding array<float>"


def brute(rows, positives=5, negatives=3, low=50, high=95):
    """From (id, label, integer vector) rows, repeats removed; anchors are the ids divisible by 50."""
    rows = sorted({(i, lab, tuple(v)) for i, lab, v in rows})
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))  # noqa: E731, B905
    out = []
    for a, lab, v in rows:
        if a % 50:
            continue
        scored = [(-dot(v, w), i, m) for i, m, w in rows]
        for ps, p, _ in sorted(s for s in scored if s[2] == lab and s[1] != a)[:positives]:
            fit = sorted(s for s in scored if s[2] != lab and low * -ps <= 100 * -s[0] <= high * -ps)[:negatives]
            out += [(a, p, k + 1, n, -ps, -ns) for k, (ns, n, _) in enumerate(fit)]
    return sorted(out)


def exact(rows):
    """The rows that take part, as integers."""
    return [(i, lab, [math.floor(256 * float(np.float32(x))) for x in v]) for i, lab, v in rows
            if None not in (i, lab, v) and all(x is not None and math.isfinite(x) for x in v)]


def run(spark, rows, **kw):
    q = L.quantized(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA + ", len2 string"))
    return sorted(tuple(r) for r in L.mine(q, q.where("vec_id % 50 = 0"), **kw).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def table(seed, n=400, dim=6, labels=4):
    rng = random.Random(seed)
    centre = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(labels)]
    rows = []
    for i in rng.sample(range(-100, 900), n):
        lab = 0 if rng.random() < 0.4 else rng.randrange(labels)
        scale = rng.choice([0.01, 0.5, 1, 1, 4])
        rows.append((i, lab, [scale * (c + rng.gauss(0, 0.6)) for c in centre[rng.choice([lab, rng.randrange(labels)])]]))
    rows += rows[:20]  # repeats
    return rows


@pytest.mark.parametrize("size,tasks,block_bytes", [(4096, None, 16 << 20), (16, 3, 16 << 20), (7, 1, 200)])
def test_equals_brute_force(spark, size, tasks, block_bytes):
    rows = table(size)
    got = run(spark, rows, size=size, tasks=tasks, block_bytes=block_bytes)
    assert len(got) > 20 and got == brute(exact(rows))


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, 1, [1.0, 0.0]), (1, 1, [0.9, 0.1]), (2, 1, [0.9, 0.1]), (3, 2, [0.6, 0.0]), (4, 2, [0.6, 0.0]), (5, 2, [0.5, 3.0]), (6, 3, [0.0, 0.0]), (7, 3, []),
            (8, 2, [0.55]), (9, 2, None), (10, None, [1.0, 1.0]), (None, 2, [0.6, 0.0]), (11, 2, [nan, 0.6]), (12, 2, [inf, 0.0]), (13, 2, [None, 0.6]),
            (50, 3, [0.0, 0.0]), (100, 9, [-1.0, 0.0]), (101, 9, [1.0, 0.0]), (0, 2, [0.7, 0.0]), (150, 4, [1.0])]
    assert run(spark, rows, size=2) == brute(exact(rows))
    assert run(spark, []) == [] and run(spark, [(1, 1, [1.0])]) == []


def test_bounds_are_exact():
    s = np.arange(-400, 400)
    low, high = L.bounds(s, 50, 95)
    for p, a, b in zip(s.tolist(), low.tolist(), high.tolist(), strict=True):
        assert all((50 * p <= 100 * x <= 95 * p) == (a <= x <= b) for x in range(-420, 420))


def test_ranges_keep_every_row_that_can_score_and_drop_others():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(2000, 4))
    x = np.floor(256 * x / np.linalg.norm(x, axis=1)[:, None] * rng.uniform(0.95, 1.05, (2000, 1))).astype(int)
    row = L.bucket_rows(1, list(range(2000)), x.tolist())
    bucket = L.Bucket(row)
    a = np.floor(256 * rng.normal(size=(50, 4))).astype("<i8")
    block = L.Block({"n": 50, "dim": 4, "ids": np.arange(50, dtype="<i8").tobytes(), "labels": np.ones(50, "<i8").tobytes(), "x": a.tobytes()})
    scores = a @ x.T
    for share, most in ((0.999, 0.3), (0.5, 1.0), (-0.5, 1.0)):
        least = (scores.max(axis=1) * share).astype(float)
        left = np.zeros(scores.shape, bool)
        for who, rows in bucket.feasible(block, np.arange(50), least):
            left[np.ix_(who, np.arange(2000) if rows is None else rows)] = True
        assert left[scores >= least[:, None]].all() and left.mean() <= most


def test_large_components(spark):
    rows = [(0, 1, [1e5, 3e5]), (1, 1, [2e5, 1e5]), (2, 2, [1e5, 1e5]), (3, 2, [9e4, 1e5 + 1])]
    assert run(spark, rows) == brute(exact(rows))
    with pytest.raises(Exception, match="fit a long"):
        run(spark, [(0, 1, [1e30]), (1, 1, [1e30])])


def test_label_shift_of_the_query(spark, tmp_path):
    spark.createDataFrame(table(3, dim=3), SCHEMA).write.parquet(str(tmp_path / "embeddings.parquet"))
    shifted = [(i, (lab + 1) % 10 if i % 7 == 0 else lab, v) for i, lab, v in exact(table(3, dim=3))]
    got = L.op13_hard_negatives(spark, str(tmp_path)).withColumn("k", F.lit(1)).drop("k")
    assert sorted(tuple(r) for r in got.collect()) == brute(shifted)
