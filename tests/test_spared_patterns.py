"""Texts without a lexicon word, or without blank ends, are spared the patterns; the results are those of the patterns."""
from pyspark.sql import functions as F

from rewrite_lake.functions import scorers as S
from rewrite_lake.functions import text as T
from rewrite_lake.sources import fixtures as FX


def test_lexicon_and_strip_equal_their_patterns(spark):
    texts = [None, "", " ", "IDIOT", "idiots an Idiot", "İdiot TRASH", "scumKlown K", "x\u0085", "  y\tz \x1c", "loser's worthless.", "a b", "\n\nq",
             "stupıd stupid", " clown ", "pathetic\x1f"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    c = F.col("t")
    got = df.select(FX.drop_lexicon(c), FX.mask_lexicon(c), S.lexicon_hits(c), T.ustrip(c)).collect()
    want = df.select(F.regexp_replace(c, FX.LEXICON_RE, ""), F.regexp_replace(c, FX.LEXICON_RE, "***"),
                     F.coalesce(F.regexp_count(c, F.lit(FX.LEXICON_RE)), F.lit(0)), F.regexp_replace(c, T._STRIP_BOTH, "")).collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in want]
    assert [r[3] for r in got] == [None if t is None else t.strip() for t in texts]


def test_most_texts_are_spared(spark):
    plain = spark.createDataFrame([("no such word here",)], "t string")
    assert not plain.select(FX.may_hold_lexicon(F.col("t"))).first()[0]
