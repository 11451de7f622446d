"""Benchmark decontamination: a BM25 index of test items, queried with block-max WAND.

The test items are indexed; every passage of every document is a query.  A
posting's impact is its BM25 weight over the item's own total and over the
share of it that a passage with enough shared shingles must reach, so one
threshold, 1, serves all items and no passage that could be verified is lost.
Passages are two neighbouring segments, each as long as the longest item of an
index, so an item's copy lies whole in one of them.

Bounds first: the block maxima of a passage's distinct terms are added up per
block of items for a whole batch at once; only passages with a block that may
reach 1 go through WAND, and what it returns is verified on word shingles of
the passage.  Where items have an answer of their own, question and answer are
verified too; of an item in one text they are measured only.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, read

K1, B = 1.2, 0.75
#: Words of a shingle, and the share of an item's shingles that a passage must hold.
SHINGLE, OVERLAP = 5, 0.8
#: Least overlap of question and answer, each by itself, where items have an answer column.
PART = 0.5
#: Items of a block, and items of one broadcast index; more items make more indexes.
BLOCK, INDEX_ITEMS = 8, 20_000
#: An index holds items of up to these many words; longer items share the last.
LENGTHS = (64, 256, 1024)
_HIT = "array<struct<item:bigint,score:double,overlap:double,question:double,answer:double,word:bigint>>"


def shingles(words: list[bytes], k: int = SHINGLE) -> set:
    """Distinct k-word shingles; of fewer words, the whole sequence."""
    if not words:
        return set()
    return {tuple(words[i:i + k]) for i in range(max(1, len(words) - k + 1))}


class Index:
    """BM25 postings of the items with block maxima.  ``items``: (id, question, answer)
    words; ``parts``: a hit needs a part of question and answer each as well."""

    def __init__(self, items: list[tuple[int, list[bytes], list[bytes]]], parts: bool = False):
        self.parts = parts
        self.ids = [i for i, _, _ in items]
        # short parts, where one changed word breaks most shingles, go by their single words
        self.question, self.answer = ([shingles(x, SHINGLE if len(x) >= 3 * SHINGLE else 1) for x in part]
                                      for part in zip(*[(q, a) for _, q, a in items], strict=True))
        texts = [q + a for _, q, a in items]
        self.whole = [shingles(t) for t in texts]
        self.longest = max(len(t) for t in texts)
        counts = [Counter(t) for t in texts]
        df = Counter(w for c in counts for w in c)
        mean = sum(map(len, texts)) / len(texts)
        posts = defaultdict(list)
        for i, c in enumerate(counts):
            norm = K1 * (1 - B + B * len(texts[i]) / mean)
            weight = {w: math.log(1 + (len(items) - df[w] + 0.5) / (df[w] + 0.5)) * n * (K1 + 1) / (n + norm) for w, n in c.items()}
            # a shingle fewer is a word fewer at most: what is left without the heaviest words
            n_miss = math.floor((1 - OVERLAP) * len(self.whole[i]) + 1e-9)
            need = sum(sorted(weight.values(), reverse=True)[n_miss:])
            for w, x in weight.items():
                posts[w].append((i, x / max(need, 1e-12) * (1 + 1e-9)))
        self.term = {w: t for t, w in enumerate(posts)}
        self.docs = [[i for i, _ in p] for p in posts.values()]
        self.impact = [[x for _, x in p] for p in posts.values()]
        self.n_blocks = (len(items) + BLOCK - 1) // BLOCK
        self.block_max = np.zeros((len(self.term), self.n_blocks), dtype=np.float32)
        for t, (ds, xs) in enumerate(zip(self.docs, self.impact, strict=True)):
            np.maximum.at(self.block_max[t], np.array(ds) // BLOCK, np.nextafter(np.array(xs, dtype=np.float32), np.float32(np.inf)))
        self.most = [max(xs) for xs in self.impact]

    def wand(self, terms) -> list[tuple[int, float]]:
        """Items whose summed impact over ``terms`` is at least 1, with it."""
        cursors = [[self.docs[t][0], t, 0] for t in terms]
        found = []
        while cursors:
            cursors.sort()
            bound, pivot = 0.0, None
            for k, (_, t, _) in enumerate(cursors):
                bound += self.most[t]
                if bound >= 1:
                    pivot = k
                    break
            if pivot is None:
                break
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            block = item // BLOCK
            tight = sum(float(self.block_max[t, block]) for _, t, _ in cursors[:pivot + 1])
            if tight < 1:  # no item up to the block's end (or the next list's item) can reach 1
                to = (block + 1) * BLOCK
                if pivot + 1 < len(cursors):
                    to = min(to, cursors[pivot + 1][0])
                to = max(to, item + 1)
                moved = cursors[:pivot + 1]
            elif cursors[0][0] == item:
                score = sum(self.impact[t][p] for _, t, p in cursors[:pivot + 1])
                if score >= 1:
                    found.append((item, score))
                to, moved = item + 1, cursors[:pivot + 1]
            else:
                to, moved = item, [c for c in cursors[:pivot] if c[0] < item]
            for c in moved:
                ds, p = self.docs[c[1]], c[2]
                while p < len(ds) and ds[p] < to:
                    p += 1
                c[2] = p
                c[0] = ds[p] if p < len(ds) else -1
            cursors = [c for c in cursors if c[0] >= 0]
        return found

    def passages(self, texts: list[list[bytes]]) -> Iterator[tuple[int, int, int]]:
        """(text, first word, last word + 1) of the passages whose bound reaches 1."""
        size, n_terms = self.longest, len(self.term)
        n_seg = [max(1, -(-len(w) // size)) for w in texts]
        first = np.concatenate([[0], np.cumsum(n_seg)])
        total = int(first[-1])
        lengths = np.array([len(w) for w in texts], dtype=np.int64)
        n_words = int(lengths.sum())
        get = self.term.get
        ids = np.fromiter((get(w, -1) for ws in texts for w in ws), dtype=np.int64, count=n_words)
        starts = np.cumsum(lengths) - lengths
        seg = np.repeat(first[:-1], lengths) + (np.arange(n_words) - np.repeat(starts, lengths)) // size
        keep = ids >= 0
        pairs = np.unique(seg[keep] * n_terms + ids[keep])
        if not len(pairs):
            return
        of, term = pairs // n_terms, pairs % n_terms
        cut = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        sums = np.zeros((total, self.n_blocks), dtype=np.float32)
        ends = np.append(cut[1:], len(of))
        step = max(1, (1 << 22) // self.n_blocks)  # bounds the gathered rows at any number of blocks
        at = 0
        while at < len(cut):
            to = max(at + 1, int(np.searchsorted(ends, cut[at] + step)))
            rows = slice(cut[at], ends[to - 1])
            sums[of[cut[at:to]]] = np.add.reduceat(self.block_max[term[rows]], cut[at:to] - cut[at], axis=0)
            at = to
        both = sums.copy()
        both[:-1] += sums[1:]
        lasts = first[1:] - 1
        both[lasts] = sums[lasts]  # a text's last segment has no neighbour
        hit = np.flatnonzero((both >= 1 - 1e-4).any(axis=1))
        for s in hit:
            d = int(np.searchsorted(first, s, side="right")) - 1
            a = (int(s) - int(first[d])) * size
            yield d, a, min(a + 2 * size, len(texts[d]))

    def search(self, texts: list[list[bytes]]) -> list[dict[int, tuple]]:
        """Per text: item -> (score, overlap, question, answer, first word of the passage)."""
        out: list[dict[int, tuple]] = [{} for _ in texts]
        for d, a, b in self.passages(texts):
            words = texts[d][a:b]
            terms = {t for t in map(self.term.get, words) if t is not None}
            hits = self.wand(terms)
            if not hits:
                continue
            have = shingles(words)
            whole = {k: {tuple(words[i:i + k]) for i in range(len(words) - k + 1)} for k in range(1, SHINGLE)}

            def share(want):
                if not want:
                    return 1.0
                return sum((x in have if len(x) == SHINGLE else x in whole[len(x)]) for x in want) / len(want)
            for i, score in hits:
                overlap = share(self.whole[i])
                if overlap + 1e-9 < OVERLAP:
                    continue
                q, w = share(self.question[i]), share(self.answer[i])
                if self.parts and min(q, w) + 1e-9 < PART:
                    continue
                old = out[d].get(self.ids[i])
                if old is None or (overlap, -a) > (old[1], -old[4]):
                    out[d][self.ids[i]] = (score, overlap, q, w, a)
        return out


def _words(text) -> list[bytes]:
    """Words, with A-Z lowered; splits exactly at space and tab to carriage return."""
    return bytes(text).lower().split() if text else []


def split_item(text: bytes) -> tuple[list[bytes], list[bytes]]:
    """Question and answer words of an item in one text: the last sentence answers."""
    words = _words(text)
    cut = max((i + 1 for i, w in enumerate(words[:-1]) if w[-1:] in b".?!"), default=len(words))
    return words[:cut], words[cut:]


def build_indexes(items: DataFrame, *, id_col: str = "item_id", question_col: str = "text", answer_col: str | None = None,
                  index_items: int = INDEX_ITEMS) -> list[Index]:
    """Indexes of all items, by length, each of at most ``index_items``.

    With ``answer_col`` a hit needs its question and answer too; else the whole
    item's overlap decides.  Blank items are left out.  Equal ids are items of their own; a null id is -1.
    """
    cols = [F.coalesce(F.col(id_col), F.lit(-1)).cast("long").alias("i"), F.col(question_col).cast("binary").alias("q")]
    cols.append((F.col(answer_col) if answer_col else F.lit(None)).cast("binary").alias("a"))
    groups = defaultdict(list)
    for r in items.select(*cols).toLocalIterator():
        q, a = (_words(r.q), _words(r.a)) if answer_col else split_item(bytes(r.q or b""))
        if q or a:
            groups[next((k for k, m in enumerate(LENGTHS) if len(q) + len(a) <= m), len(LENGTHS))].append((r.i, q, a))
    out = []
    for _, group in sorted(groups.items()):
        group.sort()
        out += [Index(group[k:k + index_items], parts=answer_col is not None) for k in range(0, len(group), index_items)]
    return out


def find(docs: DataFrame, items: DataFrame, *, text_col: str = "text", out: str = "hits", **item_cols) -> DataFrame:
    """``docs`` with an array of verified hits: (item, score, overlap, question,
    answer, word), the best passage of each item found in the whole text.

    A null or blank text has no hit; repeated rows get equal hits; without items
    no document has any; an empty ``docs`` stays empty.
    """
    (out,) = fresh(docs, out)
    indexes = docs.sparkSession.sparkContext.broadcast(build_indexes(items, **item_cols))

    @F.pandas_udf(_HIT)
    def hits(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            found: list[list] = []
            group, size = [], 0
            raw = list(batch)
            for k, text in enumerate(raw):
                group.append(_words(text))
                size += len(group[-1])
                if size > 200_000 or k == len(raw) - 1:
                    rows = [[] for _ in group]
                    for index in indexes.value:
                        for row, got in zip(rows, index.search(group), strict=True):
                            row += [{"item": i, "score": s, "overlap": o, "question": q, "answer": a, "word": w}
                                    for i, (s, o, q, a, w) in sorted(got.items())]
                    found += rows
                    group, size = [], 0
            yield pd.Series(found)
    return docs.withColumn(out, hits(F.col(text_col).cast("binary")))


def clean(docs: DataFrame, items: DataFrame, *, text_col: str = "text", **item_cols) -> DataFrame:
    """The rows of ``docs`` without a hit, columns unchanged."""
    (hits,) = fresh(docs, "hits")
    return find(docs, items, text_col=text_col, out=hits, **item_cols).where(F.size(hits) == 0).drop(hits)


def op4_decontaminate(spark, sf_dir):
    """One row per document and benchmark item that it holds."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = find(docs, read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.explode("hits").alias("h")).select(
        "doc_id", F.col("h.item").alias("item_id"), F.col("h.score").alias("score"), F.col("h.overlap").alias("overlap"),
        F.col("h.question").alias("question_overlap"), F.col("h.answer").alias("answer_overlap"), F.col("h.word").alias("first_word"))


QUERIES = {"op4_decontaminate": op4_decontaminate}
ORACLE: dict[str, str] = {}
