"""Corpus-wide operators and the pipeline against brute force, on odd input."""
import gzip
import hashlib
import os
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from rewrite_lake.llm import common, minhash_join, mixing, repeats, suffix_array, warc

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def words(t):
    return (t or "").encode().lower().split()


# --- WARC --------------------------------------------------------------------------

def pages(spark):
    big, other = "<p>é</p>" * 200, "<b>x</b>\r\n\r\nWARC/1.1\r\n" * 100
    rows = [(1, "http://a/1", big), (2, "http://a/2\r\nX: y", big), (7, None, big), (3, "http://b/1", other), (4, "u", "small"), (5, "u", "small"),
            (6, "u", None), (None, "n", big), (8, "", ""), (9, "z", other), (9, "z", other)]
    return spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("payload_digest", F.lit(0)), rows


@pytest.mark.parametrize("compression", ["none", "gzip"])
def test_warc_round_trip(spark, compression):
    df, rows = pages(spark)
    path = os.path.join(tempfile.mkdtemp(), "out")
    warc.write_warc(df, path, records_per_file=3, compression=compression)
    got = warc.read_warc(spark, path).collect()
    assert len(got) == len(rows) and len({r["file"] for r in got}) > 1
    payload = {r["record_id"]: r for r in got}
    assert bytes(payload["urn:page:7"]["payload"]) == rows[0][2].encode() and payload["urn:page:7"]["type"] == "response"
    for p in ("1", "2", ""):
        assert payload[f"urn:page:{p}"]["type"] == "revisit" and payload[f"urn:page:{p}"]["refers_to"] == "urn:page:7"
        assert payload[f"urn:page:{p}"]["payload"] is None and payload[f"urn:page:{p}"]["payload_length"] == len(rows[0][2].encode())
    assert payload["urn:page:3"]["refers_to"] == "urn:page:9" and payload["urn:page:2"]["target_uri"] == "http://a/2%0D%0AX: y"
    assert all(payload[f"urn:page:{p}"]["type"] == "response" for p in (4, 5, 6, 8, 9))
    assert payload["urn:page:7"]["target_uri"] is None and payload["urn:page:6"]["payload_length"] == 0
    for r in got:
        if r["type"] == "response":
            assert hashlib.sha1(bytes(r["payload"])).hexdigest() == r["payload_digest"]


def test_warc_filters_are_pushed_and_payloads_skipped(spark):
    df, _ = pages(spark)
    path = os.path.join(tempfile.mkdtemp(), "out")
    warc.write_warc(df, path)
    every = {(r["record_id"], r["type"]) for r in warc.read_warc(spark, path).collect()}
    cases = ["type = 'revisit'", "type <> 'revisit'", "payload_length > 1000 and type = 'response'", "target_uri like 'http://a%'", "target_uri is null",
             "payload_length in (0, 5)", "record_id like '%9'", "not (payload_length >= 1000)", "target_uri <> 'u'"]
    for c in cases:
        df = warc.read_warc(spark, path).where(c)
        direct = warc.read_warc(spark, path).cache()
        assert sorted(map(str, df.drop("payload").collect())) == sorted(map(str, direct.where(c).drop("payload").collect())), c
        direct.unpersist()
    assert every and warc.read_warc(spark, path, payload=False).where("payload is not null").count() == 0


def test_warc_reads_gzip_and_rejects_broken_files(spark):
    folder = tempfile.mkdtemp()
    rec = b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Payload-Digest: sha1:%s\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    import base64
    digest = base64.b32encode(hashlib.sha1(b"hello").digest())
    with open(f"{folder}/a.warc.gz", "wb") as f:
        f.write(gzip.compress(rec % digest) + gzip.compress(rec % digest))
    got = warc.read_warc(spark, folder).collect()
    assert [bytes(r["payload"]) for r in got] == [b"hello"] * 2 and got[0]["payload_digest"] == hashlib.sha1(b"hello").hexdigest()
    with open(f"{folder}/b.warc", "wb") as f:
        f.write((rec % digest)[:-9])
    with pytest.raises(Exception, match="breaks off"):
        warc.read_warc(spark, folder).count()
    assert warc.read_warc(spark, tempfile.mkdtemp()).count() == 0
    empty = os.path.join(tempfile.mkdtemp(), "none")
    warc.write_warc(pages(spark)[0].limit(0), empty)
    assert warc.read_warc(spark, empty).count() == 0


def test_registered_query_reads_archives_it_can_seek_in(spark):
    from rewrite_lake.llm.common import shared_dir
    before = set(os.listdir(shared_dir(spark)))
    assert warc.op5_warc(spark, "/root/testdata/sf0.001").count() > 0
    (made,) = [x for x in set(os.listdir(shared_dir(spark))) - before if x.startswith("llm-warc-")]
    files = [f for f in os.listdir(os.path.join(shared_dir(spark), made)) if f[0] not in "._"]
    assert files and not any(f.endswith(".gz") for f in files)


# --- repeats -----------------------------------------------------------------------

def test_suffix_array_is_sorted():
    rng = random.Random(1)
    for _ in range(2000):
        s = [rng.randint(0, rng.randint(0, 3)) for _ in range(rng.randint(0, 30))] * rng.randint(1, 3)
        assert suffix_array.suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


def brute_repeats(texts):
    raw = [(t or "").encode() for t in texts]
    seen = {}
    for b in raw:
        for i in range(len(b) - 199):
            seen[b[i:i + 200]] = seen.get(b[i:i + 200], 0) + 1
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - 199):
            if seen[b[i:i + 200]] > 1:
                gone[i:i + 200] = b"\1" * 200
        out.append(bytes(x for x, g in zip(b, gone, strict=True) if not g))
    return out


def repeated_corpus():
    rng = random.Random(4)
    text = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    shared, other = text(260), text(230)
    texts = [text(rng.randint(0, 900)) for _ in range(12)]
    texts += [text(rng.randint(0, 200)) + shared[:rng.randint(190, 260)] + text(rng.randint(0, 200)) for _ in range(14)]
    texts += [other + "X" + text(50), "Y" + other, shared + other + shared, "a" * 700, "ab" * 350, None, "", "short", texts[0], texts[0]]
    return texts


@pytest.mark.parametrize("most", [256, 2])
def test_repeat_removal_equals_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(repeats, "SORT_MOST", most)
    texts = repeated_corpus()
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id bigint, text string, spans int").withColumn("k1", F.lit(5))
    got = {r["doc_id"]: r for r in repeats.remove_repeats(docs).collect()}
    want = brute_repeats(texts)
    assert {i: bytes(r["kept"]) for i, r in got.items()} == dict(enumerate(want))
    for i, r in got.items():
        assert sum(s["end"] - s["start"] for s in r["spans_"]) == len((texts[i] or "").encode()) - len(want[i])


def test_long_texts_go_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(repeats, "PIECE", 300)
    import numpy as np
    rng = random.Random(9)
    part = bytes(rng.choice(b"abcd") for _ in range(900))
    texts = [part, b"x" + part[100:700] + b"y"]
    rows = list(repeats._all_runs(iter([__import__("pandas").DataFrame({"k1": [1, 2], "k2": [1, 2], "text": texts})])))
    starts = {1: set(), 2: set()}
    for pdf in rows:
        for k, at in zip(pdf["k1"], pdf["at"], strict=True):
            starts[k] |= set(range(at >> 16, (at >> 16) + ((at >> 8) & 255)))
    assert starts[1] == set(range(701)) and starts[2] == set(range(403)) and np is not None


def test_repeats_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert repeats.remove_repeats(docs).count() == 0


# --- near-duplicates ---------------------------------------------------------------

def brute_near(texts, k, percent):
    sets = []
    for t in texts:
        w = words(t)
        sets.append({tuple(w[i:i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set()))
    up = list(range(len(texts)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i
    for i in range(len(sets)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if n and 100 * n >= percent * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return [(len(s), root(i)) for i, s in enumerate(sets)]


def near_corpus():
    rng = random.Random(6)
    word = lambda: rng.choice("abcdefghijklmnop") + str(rng.randint(0, 60))
    texts = [None, "", "  \n", "one", "ONE", "two words", "two  words", "x " * 50, "x x x"]
    for _ in range(12):
        base = [word() for _ in range(rng.randint(30, 120))]
        for _ in range(rng.randint(1, 7)):
            copy = list(base)
            for _ in range(rng.randint(0, 5)):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    return texts + texts[9:14]


@pytest.mark.parametrize("small, rows, meet", [(200, 256, 64), (3, 4, 64), (3, 4, 1)])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, small, rows, meet):
    monkeypatch.setattr(minhash_join, "MEET", meet)
    monkeypatch.setattr(minhash_join, "SMALL", small)
    monkeypatch.setattr(minhash_join, "BLOCK_ROWS", rows)
    texts = near_corpus()
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, kept string").withColumn("uid", F.lit(1))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash_join.near_duplicates(docs).collect()}
    assert got == dict(enumerate(brute_near(texts, 3, 85)))


def test_near_duplicates_of_null_and_repeated_ids(spark):
    t = "the quick brown fox jumps over the lazy dog again and again"
    rows = [(None, t), (5, t), (5, t), (3, t + "!"), (None, "alone here now"), (9, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    out = minhash_join.near_duplicates(docs, threshold=0.6).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"], r["kept"]) for r in out if r["component_id"] == 3) == [(0, 3, False), (3, 3, True), (5, 3, False), (5, 3, False)]
    assert sum(r["first"] for r in out) == 3
    kept = minhash_join.drop_near_duplicates(docs, k=3, threshold=0.6)
    assert kept.columns == docs.columns and kept.count() == 3
    assert minhash_join.near_duplicates(docs.limit(0)).count() == 0


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 60)] + [(100, 101), (7, 7)], "a bigint, b bigint")
    got = {r["node"]: r["root"] for r in common.components(edges, "t").collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


# --- mixing ------------------------------------------------------------------------

def test_mix_targets_copies_and_words(spark):
    rng = random.Random(8)
    rows = [(i, " ".join("w" for _ in range(rng.randint(0, 30))), "en", "abcd"[i % 4] if i % 9 else None, 0) for i in range(400)]
    rows += [(None, None, "en", "a", 0), (None, "x y", "en", "a", 0), (1, rows[1][1], "en", rows[1][3], 0), (900, "z", "en", "tiny", 0), (901, "", "en", "blank", 0)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("size", F.lit("mine"))
    out = mixing.mix(docs)
    got = out.collect()
    assert len(got) == len(rows) and out.columns[:len(docs.columns)] == docs.columns
    total = sum(len(words(r[1])) for r in rows)
    by = {}
    for r in got:
        s = by.setdefault(r["source"], {"size": r["source_size"], "target": r["target"], "taken": 0, "most": 0})
        s["taken"] += r["taken"]
        s["most"] = max(s["most"], r["size_"])
        assert r["taken"] == r["copies"] * r["size_"] and 0 <= r["copies"] <= 3
    assert sum(s["target"] for s in by.values()) == pytest.approx(total)
    for name, s in by.items():
        assert s["target"] <= 3 * s["size"] + 1e-9 and abs(s["taken"] - s["target"]) <= (2 if name in list("abcd") else s["most"])
    again = sorted((str(r["doc_id"]), r["copies"]) for r in mixing.mix(docs.repartition(5)).collect())
    assert again == sorted((str(r["doc_id"]), r["copies"]) for r in got)
    assert mixing.mix(docs.limit(0)).count() == 0


def test_mix_weights_change_inclusion(spark):
    rows = [(i, "a b c d", "s", 0.0 if i < 50 else 2.0) for i in range(100)] + [(200 + i, "a b", "t", 1.0) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, w double")
    got = mixing.mix(docs, weight_col="w", weights=(1, 1)).where("source = 's'").collect()
    assert all(r["copies"] == 0 for r in got if r["doc_id"] < 50) and sum(r["taken"] for r in got) > 0


# --- pipeline ----------------------------------------------------------------------

def test_pipeline_equals_brute_force(spark):
    import corpus_pipeline
    rng = random.Random(10)
    word = lambda: rng.choice("bcdfghklm") + rng.choice("aeiou") + rng.choice("nrst") + str(rng.randint(0, 40))
    prose = [" ".join(word() for _ in range(rng.randint(60, 120))) for _ in range(30)]
    item = " ".join(word() for _ in range(30)) + "."
    texts = [*prose, prose[3], prose[4] + " extra", prose[5] + " " + item, prose[6] + " password=q8Zr2Lk9Xw71", "too short", "#### " * 80, None, ""]
    folder = tempfile.mkdtemp()
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 2}", len(t or "")) for i, t in enumerate(texts)], SCHEMA)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    out = {r["doc_id"]: r for r in corpus_pipeline.run(spark, folder).collect()}
    kept = [i for i, t in enumerate(texts) if t and len(t.split()) >= 50 and "#" not in t]
    roots = dict(zip(kept, brute_near([texts[i] for i in kept], 5, 80), strict=True))
    firsts = [i for n, i in enumerate(kept) if roots[i][1] == n]
    want = [i for i in firsts if item not in texts[i]]
    assert sorted(out) == want and 33 in roots and "password" not in (out[33]["text"] if 33 in out else "")
    sizes = {}
    for r in out.values():
        sizes[r["source"]] = sizes.get(r["source"], 0) + len(words(r["text"]))
    assert all(r["source_size"] == sizes[r["source"]] for r in out.values())
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "benchmark_leaks", "secret_scan", "source_mix"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns, name


@pytest.mark.parametrize("bitmap_rows", [1, 2048])
def test_warc_payloads_are_joined_only_where_digests_repeat(spark, bitmap_rows, monkeypatch):
    """Every digest in few bits, or few digests in many: the same records."""
    if bitmap_rows == 1:
        monkeypatch.setattr(warc, "BITMAP_BITS", 8)
    rows = [(i, "u", f"{i % 40:04d}" * 300 if i % 3 else f"{i:05d}" * 300) for i in range(200)]
    got = warc.plan_records(spark.createDataFrame(rows, "page_id bigint, url string, html string"), bitmap_rows=bitmap_rows).collect()
    last = {}
    for i, _, t in rows:
        last[t] = max(i, last.get(t, i))
    assert {r["page_id"]: r["refers_to"] for r in got} == {i: last[t] if last[t] != i else None for i, _, t in rows}


def test_released_paths_are_gone(spark):
    common._SCRATCH.clear()
    df = common.materialize(spark.range(3), "gone")
    path = common._SCRATCH[0].removeprefix("file:")
    assert df.count() == 3 and os.path.isdir(path)
    assert common.release(spark) == 1 and not os.path.exists(path) and common.release(spark) == 0


@pytest.mark.parametrize("weights", [None, "w"])
@pytest.mark.parametrize("small", [True, False])
def test_rank_buckets_stay_small(spark, weights, small, monkeypatch):
    """A large source with a tiny target, or one just below its whole: no bucket of the rank holds many of its rows."""
    n = 40_000
    rows = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("one two").alias("text"), F.lit("big").alias("source"), (F.col("id") % 7 + 1.0).alias("w"))
    other = spark.createDataFrame([(10**9, "x " * (30 if small else 79_900), "other", 1.0)], "doc_id bigint, text string, source string, w double")
    seen = {}
    keep = mixing.materialize
    monkeypatch.setattr(mixing, "materialize", lambda df, name: seen.setdefault(name, keep(df, name)))
    got = mixing.mix(rows.union(other), weight_col=weights, weights=(1, 10**4) if small else (1, 1))
    taken = {r["source"]: (r["t"], r["target"]) for r in got.groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("target")).collect()}
    assert abs(taken["big"][0] - taken["big"][1]) <= 4
    drawn = seen["mix-drawn"].where("source = 'big'")
    most = max((r["count"] for r in drawn.groupBy("bucket").count().collect()), default=0)
    assert most <= max(60, drawn.count() / 100)
