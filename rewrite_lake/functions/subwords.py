"""Truncation at sub-word tokens (PRJ-17): byte-pair merging with byte offsets.

A text is cut into pieces by the vocabulary's pattern; a piece starts as single
bytes, and a heap of ranked neighbours merges the pair of least rank, the
leftmost of equal ones, until no neighbours are in the vocabulary.  The text ends
where its last wanted token ends.  Merging stops with the piece that holds that
token, so a long text costs what its beginning costs.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import empty_if_null

# Fixed value: the pattern of the byte-level vocabularies' pieces.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Tokens that a model reads at most; pieces whose tokens a worker remembers.
MAX_TOKENS, MEMO = 128, 200_000


def load_ranks(path: str) -> dict[bytes, int]:
    """Token -> rank, from a file of lines ``base64(token) rank``."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def token_ends(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Where each token of a piece ends, in bytes."""
    n = len(piece)
    if n < 2 or piece in ranks:
        return [n] if n else []
    end = list(range(1, n + 1))  # end[i]: of the part that begins at i; 0 once it is merged into another
    before = list(range(-1, n - 1))

    def offer(a: int) -> tuple[int, int, int] | None:
        """The pair of the part at ``a`` and the next: (rank, place, end), if it is a token."""
        b = end[a]
        if b < n and (rank := ranks.get(piece[a:end[b]])) is not None:
            return rank, a, end[b]
        return None
    heap = [x for x in map(offer, range(n - 1)) if x]
    heapify(heap)
    while heap:
        _, a, upto = heappop(heap)
        b = end[a]
        if not b or b >= n or end[b] != upto:
            continue  # one of the two has changed since
        end[a], end[b] = upto, 0
        if upto < n:
            before[upto] = a
        for left in (before[a], a):
            if left >= 0 and (x := offer(left)):
                heappush(heap, x)
    out, at = [], 0
    while at < n:
        at = end[at]
        out.append(at)
    return out


class Cutter:
    """Cuts texts after a number of tokens; remembers pieces."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        import regex
        self.ranks, self.pattern, self.memo = ranks, regex.compile(pattern), {}

    def ends(self, piece: str) -> tuple[int, list[int]]:
        known = self.memo.get(piece)
        if known is None:
            raw = piece.encode()
            known = len(raw), token_ends(raw, self.ranks)
            if len(self.memo) >= MEMO:
                self.memo.clear()
            if len(piece) <= 64:
                self.memo[piece] = known
        return known

    def cut(self, text: str, most: int) -> tuple[str, int]:
        """(the text up to token ``most``, how many tokens that is); a character that the cut parts is left out."""
        done = n = 0
        for match in self.pattern.finditer(text) if most > 0 else ():
            size, ends = self.ends(match.group())
            if n + len(ends) >= most:
                stop = done + ends[most - n - 1]
                return text.encode()[:stop].decode("utf-8", "ignore"), most
            n += len(ends)
            done += size
        return (text if most > 0 else ""), n


_CUTTERS: dict[str, Cutter] = {}


def truncate_subwords(df: DataFrame, path: str, col: str | Column = "text", max_tokens: int = MAX_TOKENS, out: str = "truncated") -> DataFrame:
    """``df`` with ``out`` (text, n_tokens): each text's first ``max_tokens`` sub-word tokens.

    ``path`` names the vocabulary, read once on the driver and broadcast (its size
    is the file's).  NULL is an empty text; shorter texts stay whole.
    """
    ranks = df.sparkSession.sparkContext.broadcast(load_ranks(path))

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        cutter = _CUTTERS.get(path)
        if cutter is None:
            cutter = _CUTTERS[path] = Cutter(ranks.value)
        for batch in batches:
            yield pd.DataFrame([cutter.cut(t, max_tokens) for t in batch], columns=["text", "n_tokens"])
    return df.withColumn(out, F.pandas_udf(run, "text string, n_tokens int")(empty_if_null(col)))


def default_vocabulary(name: str = "byte_bpe_50k.tiktoken") -> str:
    import public_tokenizers
    return str(public_tokenizers.path(name))
