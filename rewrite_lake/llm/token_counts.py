"""Token counts by count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton enumerates every vocabulary piece in a text; the
dynamic programme keeps, per end position, the best score and how many pieces
reach it, nothing else.  Ties go as in the unigram tokenizers: candidates are
met with their starts ascending and only a strictly better score replaces one,
so the longest last piece wins.  A character without a piece of its own may be
an unknown (ten below the least score); with byte pieces it counts its bytes,
otherwise runs of unknowns count once.

No piece reaches across the start of a run of word marks, so the best path
passes through it, and a text's count is the sum over its words.  Words repeat,
so each worker remembers their counts (at most ``MEMO`` of them).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, read

MARK = "▁"
#: Words whose counts a worker remembers at once.
MEMO = 400_000
#: Unknown characters score this much below the least piece.
UNK_PENALTY = 10.0


def load_vocabulary(path: str) -> dict:
    """Pieces and scores of a sentencepiece model file (the scores as stored)."""
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(sp.get_piece_size())
    pieces = [(sp.id_to_piece(i), sp.get_score(i)) for i in ids
              if not (sp.is_unknown(i) or sp.is_control(i) or sp.is_unused(i) or sp.is_byte(i))]
    return {"pieces": pieces, "byte_fallback": any(sp.is_byte(i) for i in ids)}


class Counter(dict):
    """Word -> its number of pieces, computed when first asked for."""

    def __init__(self, vocabulary: dict):
        import ahocorasick
        super().__init__()
        self.auto = ahocorasick.Automaton()
        for piece, score in vocabulary["pieces"]:
            self.auto.add_word(piece, (len(piece), score))
            if MARK in piece.lstrip(MARK):
                raise ValueError(f"piece {piece!r} reaches across a word start")
        self.auto.make_automaton()
        self.known = {piece for piece, _ in vocabulary["pieces"] if len(piece) == 1}
        self.unk = min(score for _, score in vocabulary["pieces"]) - UNK_PENALTY
        self.bytes = vocabulary["byte_fallback"]

    def __missing__(self, word: str) -> int:
        if len(self) >= MEMO:
            self.clear()
        n = self.viterbi(word)
        if len(word) <= 64:
            self[word] = n
        return n

    def viterbi(self, word: str) -> int:
        n, low, known, unk = len(word), float("-inf"), self.known, self.unk
        best, count = [0.0] + [low] * n, [0] * (n + 1)
        gap = [False] * (n + 1)  # does the best path end here with an unknown?

        def unknown(i):
            if word[i] not in known and best[i] + unk > best[i + 1]:
                best[i + 1] = best[i] + unk
                count[i + 1] = count[i] + (len(word[i].encode("utf-8", "surrogatepass")) if self.bytes else (not gap[i]))
                gap[i + 1] = True
        done = 0
        for end, (size, score) in self.auto.iter(word):
            while done < end:
                unknown(done)
                done += 1
            start = end + 1 - size
            value = best[start] + score
            if value > best[end + 1]:
                best[end + 1], count[end + 1], gap[end + 1] = value, count[start] + 1, False
        for i in range(done, n):
            unknown(i)
        return count[n]

    def text(self, text: str) -> int:
        """Pieces of a whole text: one mark in front, spaces become marks."""
        if not text:
            return 0
        if "  " in text or MARK in text or text[0] == " " or text[-1] == " ":
            parts = re.findall(MARK + "+[^" + MARK + "]*", MARK + text.replace(" ", MARK))
        else:
            parts = (MARK + text.replace(" ", " " + MARK)).split(" ")
        return sum(map(self.__getitem__, parts))


_COUNTERS: dict[str, Counter] = {}


def count_tokens(docs: DataFrame, path: str, *, text_col: str = "text", out: str = "n_tokens") -> DataFrame:
    """``docs`` with the number of pieces of every whole text (null, empty: 0).

    The vocabulary is read once, on the driver, and broadcast: its size is that
    of the vocabulary file, whatever the data.  A clashing name gets underscores.
    """
    (out,) = fresh(docs, out)
    vocabulary = docs.sparkSession.sparkContext.broadcast(load_vocabulary(path))

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = _COUNTERS.get(path)  # a reused worker keeps its automaton
        if counter is None:
            counter = _COUNTERS[path] = Counter(vocabulary.value)
        for batch in batches:
            yield pd.Series([counter.text(t) for t in batch], dtype="int64")
    return docs.withColumn(out, count(F.coalesce(F.col(text_col), F.lit(""))))


def vocabulary_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers
    return str(public_tokenizers.path(name))


def op1_token_counts(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs, vocabulary_path()).select("doc_id", "n_tokens")


QUERIES = {"op1_token_counts": op1_token_counts}
ORACLE: dict[str, str] = {}
