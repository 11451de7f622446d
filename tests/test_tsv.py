"""Quoted records of a split TSV against the whole-file reader."""
import os
import random

import pytest
from pyspark.sql import functions as F

from rewrite_lake.sources import files as IO


def whole_file(spark, path):
    return spark.read.options(**dict(IO._CSV_IO, multiLine="true", inferSchema="false")).csv(path)


def odd_file(rng, n, end="\n"):
    """Records of three fields with quotes, doubled quotes, newlines, blank lines and junk."""
    def field():
        raw = "".join(rng.choices(["a", "b c", '""', "\n", "\n\n", "\t", "é", " ", "x"], k=rng.randint(0, 6)))
        kind = rng.random()
        if kind < 0.5:
            return '"' + raw + '"'
        plain = raw.replace("\n", "").replace("\t", "")
        return plain if not plain.startswith('"') else "q" + plain
    rows = ["k\ttext\tmore"]
    for i in range(n):
        rows.append("\t".join([f"r{i}", field(), field()]))
        if rng.random() < 0.1:
            rows.append("")
    return "\n".join(rows).replace("\n", end)


def values(df, names):
    return sorted([tuple(r[c] or "" for c in names) for r in df.collect()])


@pytest.mark.parametrize("end,seed", [("\n", 1), ("\r\n", 3)])
def test_split_records_equal_whole_file(spark, tmpdir_path, end, seed):
    path = os.path.join(tmpdir_path, "odd.tsv")
    with open(path, "w", newline="") as f:
        f.write(odd_file(random.Random(seed), 400, end))
    names = ["k", "text", "more"]
    want = values(whole_file(spark, path), names)
    records = IO.tsv_records(spark, path, block=7)
    assert records.count() == len(want) + 1
    got = IO.read_tsv(spark, path, na_tokens=(), row_id="at")
    assert values(got, names) == want
    order = [r["k"] for r in got.orderBy("at").collect()]
    assert order == [f"r{i}" for i in range(400)]
    assert [r["at"] for r in got.orderBy("at").collect()] == list(range(400))


@pytest.mark.parametrize("block", [3, 4096])
def test_states_over_blocks_and_splits(spark, tmpdir_path, block):
    path = os.path.join(tmpdir_path, "odd.tsv")
    with open(path, "w", newline="") as f:
        f.write(odd_file(random.Random(9), 300))
    want = sorted(r["record"] for r in IO.tsv_records(spark, path, block=100_000).collect())
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        got = IO.tsv_records(spark, path, block=block)
        assert spark.read.option("lineSep", "\n").text(path).rdd.getNumPartitions() > 5
        assert sorted(r["record"] for r in got.collect()) == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_quotes_inside_and_after_fields(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "q.tsv")
    with open(path, "w", newline="") as f:
        f.write('a\tb\nx"y\tz"\n"p"q\t"r\ns"\n\tonly\n"u ""v"" w"\t""\n"\n\n"\tlast\nNA\tnull')
    want = values(whole_file(spark, path), ["a", "b"])
    assert values(IO.read_tsv(spark, path, na_tokens=()), ["a", "b"]) == want and len(want) == 6
    nulls = IO.read_tsv(spark, path, row_id="n").where("n = 5").first()
    assert nulls["a"] is None and nulls["b"] is None


def test_several_files_unclosed_quotes_and_bounds(spark, tmpdir_path):
    for name, body in (("1.tsv", 'a\tb\nx\t"1\n2"\n'), ("2.tsv", 'a\tb\ny\t"open\nto the\n\nend')):
        with open(os.path.join(tmpdir_path, name), "w", newline="") as f:
            f.write(body)
    got = IO.read_tsv(spark, tmpdir_path, row_id="n").orderBy("n").collect()
    assert [(r["n"], r["a"]) for r in got] == [(0, "x"), (1, "y")]
    assert got[0]["b"] == "1\n2" and "open\nto the\n\nend" in got[1]["b"]
    with pytest.raises(Exception, match="unclosed quote"):
        IO.tsv_records(spark, tmpdir_path, record_lines=3).select(F.length("record")).collect()
    empty = os.path.join(tmpdir_path, "empty.tsv")
    with open(empty, "w") as f:
        f.write("a\tb\n")
    assert IO.read_tsv(spark, empty, row_id="n").columns == ["n", "a", "b"] and IO.read_tsv(spark, empty).count() == 0
