"""Metrics kept up to date against a full evaluation of the rows held."""
import os
import random

import pytest

from rewrite_lake.operators import eval_store as ES
from rewrite_lake.operators import metrics as M

SCHEMA = "part string, run string, toxic string, neutral1 string, model_output string, n int"
WORDS = "you idiot the cat sat on a mat 3.5 fine, good clown ok".split()


def line(rng):
    return None if rng.random() < 0.07 else " ".join(rng.choices(WORDS, k=rng.choice([0, 1, 3, 6, 9])))


def part_rows(rng, part):
    out = []
    for _ in range(rng.choice([1, 2, 5])):
        a, b = line(rng), line(rng)
        out.append((part, rng.choice(["x", "y", None]), a, b, rng.choice([a, b, line(rng)]), 1))
    return out


def same(got, want, keys):
    def table(df):
        return {tuple(r[k] for k in keys): (r["n"], *[None if r[m] is None else round(r[m], 9) for m in M.METRIC_KEYS])
                for r in df.collect()}
    got, want = table(got), table(want)
    assert got == want


def frame(spark, held):
    return spark.createDataFrame([r for rows in held.values() for r in rows], SCHEMA)


@pytest.mark.parametrize("seed", [1, 2])
def test_any_order_of_changes_equals_full_evaluation(spark, tmpdir_path, seed):
    rng = random.Random(seed)
    store = ES.EvalStore(spark, os.path.join(tmpdir_path, "s"), by=["run"])
    names, held, number = ["a", "b", "c", "d", None], {}, 0
    for step in range(6):
        kind = "change" if step == 0 else rng.choice(["change", "change", "gone", "add", "compact"])
        parts = rng.sample(names, 2)
        if kind == "compact":
            store.compact(number)
        elif kind == "add":
            more = part_rows(rng, parts[0])
            held[parts[0]] = held.get(parts[0], []) + more
            store.add(number, spark.createDataFrame(more, SCHEMA))
        else:
            new = part_rows(rng, parts[0])
            out = spark.createDataFrame([(parts[1],), ("never seen",)], "part string") if kind == "gone" else None
            if out is not None:
                held.pop(parts[1], None)
            held[parts[0]] = new
            store.change(number, spark.createDataFrame(new, SCHEMA), out)
            if rng.random() < 0.5:                       # the same change once more
                store.change(number, spark.createDataFrame(new, SCHEMA), out)
        number += 1
    rows = frame(spark, held)
    same(store.metrics(), M.evaluate_pairs(rows, by=["run"]), ["run"])
    same(store.metrics(by=[]), M.evaluate_pairs(rows), [])
    same(store.metrics(by=["part"]), M.evaluate_pairs(rows, by=["part"]), ["part"])


def test_everything_gone_leaves_nothing(spark, tmpdir_path):
    rng = random.Random(5)
    store = ES.EvalStore(spark, os.path.join(tmpdir_path, "s"))
    rows = [r for p in "ab" for r in part_rows(rng, p)] + [("c", "x", None, "t", "u", 1)]
    store.change(3, spark.createDataFrame(rows, SCHEMA))
    store.change(8, gone=spark.createDataFrame([("a",), ("b",), ("c",)], "part string"))
    assert store.parts().count() == 0
    got = store.metrics().collect()
    assert len(got) == 1 and got[0]["n"] == 0 and got[0]["STA"] is None and got[0]["BLEU"] == 0.0


def test_unfinished_change_is_not_read_and_numbers_rise(spark, tmpdir_path):
    rng = random.Random(6)
    path = os.path.join(tmpdir_path, "s")
    store = ES.EvalStore(spark, path)
    with pytest.raises(ValueError):
        store.metrics()
    a, b = part_rows(rng, "a"), part_rows(rng, "b")
    store.change(1, spark.createDataFrame(a, SCHEMA))
    store.change(2, spark.createDataFrame(b, SCHEMA))
    os.rename(os.path.join(path, "delta-000000000002", "_SUCCESS"), os.path.join(path, "delta-000000000002", "_kept"))
    same(store.metrics(), M.evaluate_pairs(spark.createDataFrame(a, SCHEMA)), [])
    store.change(2, spark.createDataFrame(b, SCHEMA))
    same(store.metrics(), M.evaluate_pairs(spark.createDataFrame(a + b, SCHEMA)), [])
    with pytest.raises(ValueError):
        store.change(1, spark.createDataFrame(a, SCHEMA))
    store.compact(3)
    with pytest.raises(ValueError):
        store.change(3, spark.createDataFrame(a, SCHEMA))
    assert [kind for _, kind, _ in store._folders()] == ["base"]


def test_empty_table_and_rows_of_zeros(spark, tmpdir_path):
    store = ES.EvalStore(spark, os.path.join(tmpdir_path, "s"), by=["run"])
    store.change(0, spark.createDataFrame([], SCHEMA))
    assert store.metrics().count() == 0
    store.change(1, spark.createDataFrame([("a", "x", "t u", "v", "w", 1)], SCHEMA))
    store.change(2, spark.createDataFrame([("a", "x", None, "v", "w", 1)], SCHEMA))
    assert store.metrics().count() == 0 and store.parts().count() == 0
