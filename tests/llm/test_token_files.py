"""Token files: ids against the library, exact round trips, seeking, damage."""
import json
import os
import random
import tempfile
import zlib

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rewrite_lake.llm import token_files as T

ROWS = [(5, "Hello, World's 1234 café café"), (2, None), (3, ""), (9, "tab\tsep\n\nlines \x0b\x0c \x1c \x85   z  "), (-4, "ΣΑΣ ẍ y'LL don't"),
        (None, "no id"), (5, "again"), (7, "word " * 40000), (8, "x" * 3000), (11, "<|endoftext|> a<|startoftext|>b"), (12, "́start of marks ̀ ́x")]


def ids_of(text):
    t = Tokenizer.from_file(T.vocabulary_path())
    return [*t.encode(text or "", add_special_tokens=False).ids, 1]


def folder():
    return os.path.join(tempfile.mkdtemp(), "ids")


def test_round_trip_in_order(spark, monkeypatch):
    df = spark.createDataFrame([(*r, 0) for r in ROWS], "doc_id bigint, text string, ids int")
    for width, parts, file_ids in ((4, 3, 50), (2, 1, 1 << 20)):
        path = folder()
        T.write_ids(df, path, T.vocabulary_path(), width=width, parts=parts, file_ids=file_ids)
        rows = sorted(T.read_ids(spark, path).collect(), key=lambda r: r["start"])
        assert [r["doc_id"] for r in rows] == [None, -4, 2, 3, 5, 5, 7, 8, 9, 11, 12]
        assert [r["start"] for r in rows] == [0, *np.cumsum([r["n_tokens"] for r in rows])[:-1].tolist()]
        got = sorted((str(r["doc_id"]), np.frombuffer(bytes(r["ids"]), "<u4").tolist()) for r in rows)
        assert got == sorted((str(d), ids_of(t)) for d, t in ROWS)
        files = json.load(open(f"{path}/{T.LIST}"))["files"]
        assert (len(files) > 3) == (file_ids == 50) and len([x for x in os.listdir(path) if x.startswith("ids-")]) == len(files)
        # the same ids, to any zstandard decoder
        plain = b"".join(zstandard.ZstdDecompressor().stream_reader(open(f"{path}/{f['name']}", "rb"), read_across_frames=True).read() for f in files)
        assert np.frombuffer(plain, f"<u{width}").tolist() == [i for r in rows for i in np.frombuffer(bytes(r["ids"]), "<u4").tolist()]


def test_query_columns(spark):
    path = folder()
    T.write_ids(spark.createDataFrame(ROWS[:5], "doc_id bigint, text string"), path, T.vocabulary_path(), width=2)
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["c"]) for r in T.read_ids(spark, path).withColumn("c", F.crc32("ids")).collect()}
    start = 0
    for d, t in sorted(ROWS[:5]):
        ids = ids_of(t)
        assert got[d] == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_only_wanted_frames_are_decompressed(monkeypatch):
    monkeypatch.setattr(T, "FRAME_IDS", 10)
    rng, path = np.random.default_rng(1), folder()
    docs = [(i, rng.integers(0, 9, rng.integers(0, 35)).astype("<u4")) for i in range(200)]
    with open(path, "wb") as out:
        w = T.FileWriter(out, 2)
        for d, ids in docs:
            w.add(d, ids)
        w.close()
    with open(path, "rb") as raw:
        r = T.FileReader(raw, os.path.getsize(path))
        for i, ids in r.ids(list(range(200))):
            assert ids.tolist() == docs[i][1].tolist()
        assert r.decoded == len(r.entries) - 1  # every frame once
        r.decoded = 0
        (_, ids), = r.ids([100])
        assert ids.tolist() == docs[100][1].tolist() and r.decoded <= 5
        assert max(r.entries[:-1, 1]) <= 20


def test_conditions_are_pushed(spark):
    path = folder()
    T.write_ids(spark.createDataFrame([(i, f"w{i}") for i in range(100)] + [(None, "n")], "doc_id bigint, text string"), path,
                T.vocabulary_path(), parts=5, file_ids=40)
    every = T.read_ids(spark, path)
    for where in ("doc_id = 7", "doc_id in (3, 50, 99)", "doc_id > 90 and doc_id <= 95", "doc_id is null", "doc_id < 0", "doc_id <=> 5", "doc_id >= 98", "start > 100"):
        keep = {r["doc_id"] for r in spark.createDataFrame([(r["doc_id"], r["start"]) for r in every.collect()], "doc_id bigint, start bigint").where(where).collect()}
        assert {r["doc_id"] for r in every.where(where).collect()} == keep, where
    reader = T.TokenReader({"path": path})
    assert list(reader.pushFilters([T.EqualTo(("doc_id",), 7)])) == [] and len(reader.partitions()) < 4
    assert T.read_ids(spark, path, ids=False).where("ids is not null").isEmpty()


def test_damage_is_found(spark):
    path = folder()
    T.write_ids(spark.createDataFrame([(1, "some words of a text")], "doc_id bigint, text string"), path, T.vocabulary_path(), width=2)
    name = f"{path}/{json.load(open(f'{path}/{T.LIST}'))['files'][0]['name']}"
    data = bytearray(open(name, "rb").read())
    for at in (12, len(data) - 20, len(data) - 2):
        bad = bytearray(data)
        bad[at] ^= 1
        with open(name, "wb") as out:
            out.write(bad)
        with pytest.raises(Exception, match="damaged|checksum|seek table|breaks off"), open(name, "rb") as raw:
            list(T.FileReader(raw, len(bad)).ids([0]))


def test_nothing_shows_without_a_commit(spark):
    path = folder()
    spark.dataSource.register(T.TokenSource)
    bad = spark.createDataFrame([(i, None if i < 50 else 70000) for i in range(60)], "doc_id bigint, x int").repartition(4)
    ids = bad.select("doc_id", F.unhex(F.when(F.col("x").isNull(), "01000000").otherwise("70110100")).alias("ids"))
    with pytest.raises(Exception, match="65535"):
        ids.write.format("token_ids").option("width", 2).mode("append").save(path)
    assert not [x for x in os.listdir(path) if not x.startswith("ids-")]
    with pytest.raises(Exception, match=T.LIST):
        T.read_ids(spark, path).count()
    ids.write.format("token_ids").mode("append").save(path)
    assert T.read_ids(spark, path).count() == 60
    with pytest.raises(Exception, match="already holds"):
        ids.write.format("token_ids").mode("append").save(path)
    assert T.read_ids(spark, path).count() == 60


def test_empty_table(spark):
    path = folder()
    T.write_ids(spark.createDataFrame([], "doc_id bigint, text string"), path, T.vocabulary_path())
    assert T.read_ids(spark, path).count() == 0


def test_chunks_equal_whole_texts(monkeypatch):
    """Odd characters, short memory: a text's ids are its chunks' ids joined."""
    monkeypatch.setattr(T, "MEMO", 50)
    rng, coder = random.Random(3), T.Encoder(T.vocabulary_path())
    marks = [chr(i) for i in range(0x260)] + list("ΣςσİıẞΩé中文ǅ̧́\u2000\u3000\u200bﬁ½Ⅷ'st") + ["'s", "'LL", " ", "  ", ". ", ", ", "<|endoftext|>"] * 9
    texts = ["".join(rng.choices(marks, k=rng.randint(0, 60))) for _ in range(3000)] + ["a. b, c' 'd it's. end!? .", "", " "]
    assert coder.chunked
    plain = [t for t in texts if "<|" not in t]
    assert coder.texts(pa.array(plain, pa.large_string()), [1]).to_pylist() == [coder.whole(t) + b"\1\0\0\0" for t in plain]
    assert coder.texts(pa.array(texts, pa.large_string()), []).to_pylist() == [coder.whole(t) for t in texts]


def test_texts_of_a_vocabulary_that_keeps_blanks(spark):
    import public_tokenizers
    other = str(public_tokenizers.path("byte_bpe_50k.json"))
    t = Tokenizer.from_file(other)
    got = {r["doc_id"]: np.frombuffer(bytes(r["ids"]), "<u4").tolist()
           for r in T.encode(spark.createDataFrame([(1, " two  words\n")], "doc_id bigint, text string"), other, end_id=None).collect()}
    assert got[1] == t.encode(" two  words\n", add_special_tokens=False).ids


def test_all_texts_of_the_test_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    t = Tokenizer.from_file(T.vocabulary_path())
    got = {r["doc_id"]: zlib.crc32(bytes(r["ids"])) for r in T.encode(docs, T.vocabulary_path(), end_id=None).collect()}
    assert got == {r["doc_id"]: zlib.crc32(np.array(t.encode(r["text"] or "", add_special_tokens=False).ids, "<u4").tobytes()) for r in docs.collect()}
