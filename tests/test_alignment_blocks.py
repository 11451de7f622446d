"""Word alignment keeps no table of meeting words, and rewrites ask once for a chunk's words."""
import glob
import os
import random

import pytest

from rewrite_lake.operators import alignment as AL
from rewrite_lake.session import ensure_checkpoint_dir
from tests.test_models import em


def _files(spark):
    home = ensure_checkpoint_dir(spark).removeprefix("file:")
    return {f: os.path.getsize(f) for f in glob.glob(f"{home}/**/*.parquet", recursive=True)}


def test_alignment_stores_words_not_their_meetings(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(120)), " ".join(f"v{rng.randrange(10**6)}" for _ in range(120))) for i in range(20)]
    before = _files(spark)
    n = AL.align_words(spark.createDataFrame(rows, "pair_id int, input string, target string").repartition(2), rounds=2).count()
    made = sum(size for f, size in _files(spark).items() if f not in before)
    assert n > 250_000 and made < n  # less than a byte for each of the cells


@pytest.mark.parametrize("cells", [1, 40, 1 << 21])
def test_columns_equal_plain_rounds_in_pieces_of_any_size(spark, monkeypatch, cells):
    import numpy as np
    import pyarrow as pa
    rng = random.Random(cells)
    # numbers stand for hashes: 0 for the empty word
    pairs = [(i, [0, *rng.choices(range(1, 9), k=rng.randint(0, 6))], rng.choices(range(20, 30), k=rng.randint(0, 6))) for i in range(60)]
    pairs += [(60 + i, pairs[i][1], [21]) for i in range(20)]
    plain = [(i, " ".join(map(str, s[1:])), " ".join(map(str, t))) for i, s, t in pairs]
    monkeypatch.setattr(AL, "CELLS", cells)
    batches = [pa.RecordBatch.from_pydict({"src": [p[1] for p in part], "tgt": [p[2] for p in part]},
                                          schema=pa.schema([("src", pa.list_(pa.int64())), ("tgt", pa.list_(pa.int64()))])) for part in (pairs[:33], pairs[33:])]
    pieces = {}
    for b in AL._deal(iter(batches), 3):
        pieces.setdefault(b.column("block")[0].as_py(), []).append(b.column("piece")[0].as_py())
    blocks = [AL._Block(p) for p in pieces.values()]
    totals = []
    for r in (1, 2, 3):
        e = {}
        for b in blocks:
            mine = [np.array([t[w] for w in b.words.tolist()]) for t in totals]
            for s, t, v in b.columns(mine, r):
                for x in zip(b.words[s].tolist(), t.tolist(), v.tolist(), strict=True):
                    assert x[:2] not in e
                    e[x[:2]] = x[2]
        total = {}
        for (s, _), v in e.items():
            total[s] = total.get(s, 0) + v
        totals.append(total)
        want = em(plain, r)
        got = {("" if s == 0 else str(s), str(t)): v / total[s] for (s, t), v in e.items()}
        assert got.keys() == want.keys() and all(abs(got[c] - want[c]) < 1e-12 for c in want)


def test_pairs_of_one_key_are_one_pair(spark):
    rows = [(1, "a b", "x"), (1, "c", "y"), (2, "a", "z"), (None, "a", "x"), (None, "b", None)]
    one = [(1, "a b \x1c c", "x y"), (2, "a", "z"), (None, "a b", "x")]
    schema = "pair_id int, input string, target string"
    got, want = ({(r["s"], r["t"]): r["p"] for r in AL.align_words(spark.createDataFrame(x, schema)).collect()} for x in (rows, one))
    assert got.keys() == want.keys()  # the empty word counts once a row, so shares differ
    assert ("c", "x") in got and ("b", "x") in got


def test_cheapest_ways_need_few_places():
    rng = random.Random(3)
    for _ in range(400):
        lists = [sorted(rng.choices([3, 4, 5, 8], k=rng.randint(1, 4))) for _ in range(rng.randint(0, 6))]
        for k in (1, 2, 3, 5):
            want = [[(i, o) for i, o in enumerate(way) if o] for way in AL.k_best(lists, k)]
            assert AL.cheapest(lists, k) == want


def test_rewrites_of_repeated_keys_and_chunks(spark, monkeypatch):
    monkeypatch.setattr(AL, "CHUNK", 1)
    options = spark.createDataFrame([("bad", [(0, 5, "good"), (1, 7, "fine")])], "s string, options array<struct<rank:int,cost:bigint,target:string>>")
    rows = [(i, f"bad w{i}") for i in range(9)] + [(3, "bad bad"), (3, None), (4, " ")]
    out = AL.rewrites(spark.createDataFrame(rows, "sample_id int, source string"), options, k=2).collect()
    got = sorted((r["sample_id"], r["candidate_rank"], r["text"]) for r in out)
    want = [(i, r, f"{w} w{i}") for i in range(9) if i != 3 for r, w in enumerate(("good", "fine"))]
    want += [(3, 0, "good good good w3"), (3, 1, "fine good good w3"), (3, 0, ""), (4, 0, "")]
    assert got == sorted(want)
