"""BLEU counts no n-grams of a hypothesis that the reference begins or ends with."""
import random
import re
from collections import Counter

import pandas as pd
import pytest

from rewrite_lake.functions import bleu as B


def _rows(pairs):
    (out,) = B._stats(iter([tuple(pd.Series(x, dtype=object) for x in zip(*pairs, strict=True))]))
    return [tuple(None if pd.isna(v) else v for v in r) for r in out.itertuples(index=False)]


def test_cut_texts_count_no_ngrams(monkeypatch):
    monkeypatch.setattr(B, "_matches", lambda *a: pytest.fail("n-grams were counted"))
    ref = "one two, one two three one two one."
    for hyp in ("one two,", "one two one.", "one  two, one two three one two one.", "one", "two one ."):
        (row,) = _rows([(hyp, ref)])
        assert row[:4] == row[4:8] and row[9] == 10


def test_stats_equal_plain_counts():
    rng = random.Random(9)
    pairs = []
    for _ in range(600):
        ref = rng.choices(["a", "b", "c.", "d", "a-b", "3", "3-4", "1,5"], k=rng.randint(0, 9))
        cut = rng.randint(0, 9)
        hyp = rng.choice([ref[:cut], ref[cut:], ref[1:cut], rng.choices(["a", "b", "c."], k=cut)])
        pairs.append((" ".join(hyp), " ".join(ref)))
    for (hyp, ref), row in zip(pairs, _rows(pairs), strict=True):
        x, y = B.tokens_13a(hyp), B.tokens_13a(ref)
        for n in range(1, 5):
            mine, theirs = (Counter(zip(*(t[i:] for i in range(n)), strict=False)) for t in (x, y))
            assert row[n - 1] == (mine & theirs).total() and row[n + 3] == max(len(x) - n + 1, 0)


def test_plain_words_need_no_rules():
    rng = random.Random(1)
    for _ in range(4000):
        word = "".join(rng.choices("aZé٣9²ß.,-&'!", k=rng.randint(1, 5)))
        text = word
        for search, repl in B._UNESCAPES:
            text = text.replace(search, repl)
        text = f" {text} "
        for pattern, repl in B._REWRITES:
            text = re.sub(pattern, repl.replace("$", "\\"), text)
        assert B._Words()[word] == tuple(text.split()), word
