"""Candidates dealt over runs of a stream against the batch rerank."""
import os
import random
from datetime import datetime, timezone

import pytest

from rewrite_lake.functions.intervals import milliseconds
from rewrite_lake.operators import rerank as RR
from rewrite_lake.streaming import late_candidates as LC

SCHEMA = ("doc bigint, line string, source string, reference string, model_idx int, model string, candidate_rank int, "
          "text string, n_expected int, event_time timestamp")
KEYS = ["doc", "line"]
WORDS = "you idiot the cat sat on a mat good clown ok fine".split()


def at(seconds):
    return datetime.fromtimestamp(seconds, timezone.utc)


def candidates(rng, n=14):
    rows = []
    for i in range(n):
        key = (None if i == 3 else i, None if i == 4 else "l")
        source = " ".join(rng.choices(WORDS, k=6))
        have = [(m, r) for m in range(2) for r in range(rng.choice([1, 2]))]
        for m, r in have:
            text = rng.choice([source, "", None, " ".join(rng.choices(WORDS, k=4))])
            rows.append((*key, source, source, m, f"m{m}", r, text, len(have), at(100 + r)))
    return rows


def stream(spark, home, runs, **options):
    """One run of the stream per list of rows, over the same checkpoint."""
    for rows in runs:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{home}/in")
        q = LC.start(spark.readStream.schema(SCHEMA).parquet(f"{home}/in"), f"{home}/out", f"{home}/ckpt", key=KEYS, **options)
        q.awaitTermination()
        assert q.exception() is None
    return spark.read.parquet(f"{home}/out").collect()


@pytest.mark.parametrize("seed", [1, 2])
def test_any_dealing_equals_batch(spark, tmpdir_path, seed):
    rng = random.Random(seed)
    rows = candidates(rng)
    runs = [[], [], []]
    for r in rows:
        for _ in range(rng.choice([1, 1, 2])):          # some arrive twice, in any run
            runs[rng.randrange(3)].append(r)
    for r in runs:
        rng.shuffle(r)
    got = stream(spark, tmpdir_path, [r for r in runs if r], lateness="1 hour")
    batch = RR.score_candidates(RR.prepare_samples(spark.createDataFrame(rows, SCHEMA)))
    want = {(r["doc"], r["line"]): (r["model_idx"], r["candidate_rank"], r["text"], r["objective"]) for r in RR.top1(batch, KEYS).collect()}
    assert {(r["doc"], r["line"]): (r["model_idx"], r["candidate_rank"], r["text"], r["objective"]) for r in got} == want
    assert len(got) == len(want) and all(r["complete"] and r["n_seen"] == r["n_expected"] for r in got)


def test_time_out_gives_the_best_seen_once(spark, tmpdir_path):
    def row(doc, rank, text, seconds, n=2):
        return (doc, "l", "the cat sat", "the cat sat", 0, "m", rank, text, n, None if seconds is None else at(seconds))
    runs = [[row(1, 0, "the cat sat", 100), row(2, 0, "cat", 100), row(3, 0, "the cat", 100, None), row(5, 0, "x", None)],
            [row(2, 1, "the cat sat", 110), row(4, 0, "far ahead", 5000, 1)],
            [row(1, 1, "too late", 120), row(2, 0, "cat", 100), row(4, 0, "far ahead", 5000, 1)],
            [row(6, 0, "the end", 9000, 1)]]
    got = stream(spark, tmpdir_path, runs, patience="1 minute")
    have = sorted((r["doc"], r["text"], r["n_seen"], r["n_expected"], r["complete"]) for r in got if r["doc"] != 3)
    assert have == [(1, "the cat sat", 1, 2, False), (2, "the cat sat", 2, 2, True), (4, "far ahead", 1, 1, True), (6, "the end", 1, 1, True)]
    assert [(r["text"], r["n_expected"], r["complete"]) for r in got if r["doc"] == 3] == [("the cat", None, False)]


def test_lengths_of_time():
    assert milliseconds("10 minutes") == 600_000 and milliseconds("1 hour 30 seconds") == 3_630_000
    with pytest.raises(ValueError):
        milliseconds("soon")


def test_the_state_function_gets_a_candidate_as_one_column(spark, tmpdir_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmpdir_path}/in")
    best = LC.best_of_stream(spark.readStream.schema(SCHEMA).parquet(f"{tmpdir_path}/in"), key=KEYS)
    node = best._jdf.queryExecution().analyzed()
    while node.nodeName() != "FlatMapGroupsInPandasWithState":
        node = node.children().head()
    given = node.children().head().output()
    assert sorted({given.apply(i).name() for i in range(given.size())}) == sorted([*KEYS, LC._PACKED, "event_time"])
    assert best.columns == [*KEYS, "model_idx", "model", "candidate_rank", "text", "objective", "n_seen", "n_expected", "complete"]


def test_any_text_and_score_comes_back(spark, tmpdir_path):
    texts = ['"quoted" \\ back', "line\nend\ttab\r", "\u0000   é \U0001f600", "{}", "", None, "NaN", "x" * 70_000]
    rows = [(i, None, t or "", t, 0, None if i % 2 else 'm"\\', 0, t, None if i == 1 else 1, at(100)) for i, t in enumerate(texts)]
    rows.append((99, "l", "the end", "the end", 0, "m", 0, "the end", 1, at(9000)))
    got = stream(spark, tmpdir_path, [rows, [(100, "l", "x", "x", 0, "m", 0, "x", 1, at(9001))]], patience="1 minute")
    batch = RR.score_candidates(RR.prepare_samples(spark.createDataFrame(rows, SCHEMA))).collect()
    want = {r["doc"]: (r["model"], r["text"], r["objective"]) for r in batch}
    assert {r["doc"]: (r["model"], r["text"], r["objective"]) for r in got if r["doc"] != 100} == want
    assert {r["doc"] for r in got if not r["complete"]} == {1}
