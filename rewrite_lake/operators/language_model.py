"""Acceptability by a smoothed language model (UDF-02): modified Kneser-Ney.

Trigram counts of the training texts give continuation counts of bigrams and
words; the counts of counts of each order give its three discounts.  All that is
looked up for a trigram (a, b, c) but the words' own share lies with its middle
word, so trigrams are dealt over blocks by ``b``, in packed pieces: those of the
training texts and, once, those of the texts to score.  A block counts its part of
the model, looks its trigrams up and hands back one sum a text.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark import RDD
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from ..functions.text import empty_if_null
from ..session import stored

#: Padding before a text and after it; no whitespace token equals them.
START, END = " <", " >"
#: Stands for a discount whose counts of counts are missing, or that would not be positive (tiny corpora).
PLAIN_DISCOUNT = 0.75
#: Characters of text to score and to train on in a block about, and packed together.  Blocks at least (each can be one task).
BLOCK_CHARS, FIT_CHARS, CHUNK_CHARS, BLOCKS = 1 << 25, 1 << 23, 1 << 23, 8
#: Words whose hashes a task keeps at most.
WORDS_KEPT = 1 << 18


@dataclass
class KneserNey:
    """The training texts and their packed trigrams by block, discounts of trigrams and bigrams, and the
    words' hashes in order with their shares (one number a word); ``rest`` is that of a new word."""
    texts: DataFrame
    home: RDD
    blocks: int
    d3: list[float]
    d2: list[float]
    words: np.ndarray
    shares: np.ndarray
    rest: float


def discounts(n1: int, n2: int, n3: int, n4: int) -> list[float]:
    """The discounts of counts 1, 2 and 3 or more, from how many n-grams are met 1 to 4 times."""
    met, out = [float(n1), float(n2), float(n3), float(n4)], []
    for i in (1, 2, 3):
        if not (met[0] and met[i - 1] and met[i]):
            out.append(PLAIN_DISCOUNT)
            continue
        value = i - (i + 1) * (met[0] / (met[0] + 2 * met[1])) * met[i] / met[i - 1]
        out.append(min(float(i), value) if value > 0 else PLAIN_DISCOUNT)  # some mass is always left over
    return out


class _Hashes(dict):
    """64-bit hashes of words, kept for the words met lately."""

    def __missing__(self, word: str) -> int:
        if len(self) >= WORDS_KEPT:
            self.clear()
        self[word] = found = int.from_bytes(blake2b(word.encode(), digest_size=8).digest(), "little", signed=True)
        return found


def _planes(x: np.ndarray) -> bytes:
    return x.view(np.uint8).reshape(-1, x.dtype.itemsize).T.tobytes()


def _pack(words: np.ndarray, *counts: np.ndarray) -> bytes:
    """Sorted hashes, as steps, and numbers below 2**31: their bytes by place, which compress better."""
    return zlib.compress(pickle.dumps([_planes(np.diff(words, prepend=0).astype("<i8")), *[_planes(x.astype("<i4")) for x in counts]]), 1)


def _unpack(piece: bytes) -> list[np.ndarray]:
    words, *counts = [np.frombuffer(x, np.uint8) for x in pickle.loads(zlib.decompress(piece))]
    return [np.cumsum(words.reshape(8, -1).T.copy().view("<i8").ravel()), *[x.reshape(4, -1).T.copy().view("<i4").ravel().astype(np.int64) for x in counts]]


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Runs of rows with about ``CHUNK_CHARS`` of text."""
    for batch in batches:
        texts = batch.column("text").to_pylist()
        at = size = 0
        for i, text in enumerate(texts):
            size += len(text)
            if size >= CHUNK_CHARS or i == len(texts) - 1:
                yield batch.slice(at, i + 1 - at), texts[at:i + 1]
                at, size = i + 1, 0


def _trigrams(known: _Hashes, texts: list[str]) -> tuple[np.ndarray, ...]:
    """(words, text, a, b, c): every trigram of the padded texts, its words by place among all."""
    start, end, flat, sizes = known[START], known[END], [], []
    for text in texts:
        before = len(flat)
        flat += [start, start]
        flat.extend(map(known.__getitem__, text.split()))
        flat.append(end)
        sizes.append(len(flat) - before)
    words, at = np.unique(np.array(flat, dtype=np.int64), return_inverse=True)
    del flat
    at, sizes = at.astype(np.int32), np.array(sizes)
    text = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    ends = np.cumsum(sizes)
    first = np.ones(len(at), dtype=bool)
    first[ends - 1] = first[ends - 2] = False
    i = np.flatnonzero(first)
    return words, text[i], at[i], at[i + 1], at[i + 2]


def _by_block(words, b, blocks: int) -> Iterator[tuple[int, np.ndarray]]:
    home = (words.view(np.uint64) % np.uint64(blocks)).astype(np.int64)[b]
    order = np.argsort(home, kind="stable")
    cuts = np.searchsorted(home[order], np.arange(blocks + 1))
    for block in range(blocks):
        if cuts[block] < cuts[block + 1]:
            yield block, order[cuts[block]:cuts[block + 1]]


def _own_words(words, *ids) -> tuple[np.ndarray, ...]:
    """Only the words that are used, and the places among them."""
    used = np.zeros(len(words), dtype=bool)
    for x in ids:
        used[x] = True
    place = np.cumsum(used, dtype=np.int32) - 1
    return words[used], *[place[x] for x in ids]


def _counted(a, b, c, n) -> tuple[np.ndarray, ...]:
    """Distinct (a, b, c), in order of b, a and c, with the sums of ``n``."""
    order = np.lexsort((c, a, b))
    a, b, c, n = a[order], b[order], c[order], n[order]
    new = np.ones(len(a), dtype=bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (c[1:] != c[:-1])
    return a[new], b[new], c[new], np.add.reduceat(n, np.flatnonzero(new)) if len(n) else n


def _deal(blocks: int, keyed: bool):
    """Rows (text), or (key, text), -> (block, packed trigrams): counted, or with the place of their text and all keys."""
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Hashes()
        for rows, texts in _chunks(batches):
            words, text, a, b, c = _trigrams(known, texts)
            for block, mine in _by_block(words, b, blocks):
                own, x, y, z = _own_words(words, a[mine], b[mine], c[mine])
                if keyed:
                    there, at = np.unique(text[mine], return_inverse=True)
                    keys = pa.RecordBatch.from_arrays([rows.column("key").take(pa.array(there))], names=["key"])
                    sink = pa.BufferOutputStream()
                    with pa.ipc.new_stream(sink, keys.schema) as out:
                        out.write_batch(keys)
                    piece = pickle.dumps((zlib.compress(sink.getvalue().to_pybytes(), 1), _pack(own, x, y, z, np.diff(at, prepend=0))))
                else:
                    piece = _pack(own, *_counted(x, y, z, np.ones(len(x), dtype=np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([piece], pa.binary())], names=["block", "piece"])
    return deal


def _home(block: int) -> int:
    return block


def _dealt(texts: DataFrame, blocks: int, keyed: bool) -> RDD:
    """(block, (keyed, piece)), shuffled once however often it is read."""
    pieces = texts.mapInArrow(_deal(blocks, keyed), "block int, piece binary")
    return pieces.rdd.map(lambda r: (r["block"], (keyed, bytes(r["piece"])))).partitionBy(blocks, _home)


def _prepared(texts: DataFrame, text: str, *keep) -> DataFrame:
    return texts.select(*keep, F.lower(empty_if_null(text)).alias("text"))


class _Part:
    """The trigrams with some middle words, counted: ``a``, ``b``, ``c`` are places in ``words``."""

    def __init__(self, pieces: list[bytes]):
        parts = [_unpack(x) for x in pieces]
        self.words = np.unique(np.concatenate([x[0] for x in parts])) if parts else np.zeros(0, dtype=np.int64)
        ids = [[np.searchsorted(self.words, x[0])[x[i]] for i in (1, 2, 3)] + [x[4]] for x in parts]
        self.a, self.b, self.c, self.n = _counted(*[np.concatenate(x) for x in zip(*ids, strict=True)]) if parts else [self.words] * 4
        # bigrams: how many different words stand before them
        self.bi, self.n2 = np.unique(self.b * len(self.words) + self.c, return_counts=True)

    def model(self, d3: list[float], d2: list[float]) -> None:
        v = max(len(self.words), 1)
        pair = self.b * v + self.a
        self.pairs, which = np.unique(pair, return_inverse=True)
        self.p3, self.g3 = _shares(self.n, which, len(self.pairs), d3)
        self.tri = which * v + self.c  # in order
        self.p2, self.g2 = _shares(self.n2, self.bi // v, v, d2)

    def find(self, words, a, b, c, share: np.ndarray) -> np.ndarray:
        """log p(c | a b) of trigrams of ``words``; ``share`` is what each of the words has by itself."""
        v = len(self.words)
        if not v:
            return np.log(share[c])
        place = np.searchsorted(self.words, words)
        place[place == v] = 0
        known = self.words[place] == words
        x, y, z = place[a], place[b], place[c]
        met = known[b]
        p = np.where(met, self.g2[y], 1.0) * share[c]
        at = np.flatnonzero(met & known[c])
        i, found = _seek(self.bi, y[at] * v + z[at])
        p[at[found]] += self.p2[i[found]]
        at = np.flatnonzero(met & known[a])
        pair, found = _seek(self.pairs, y[at] * v + x[at])
        at, pair = at[found], pair[found]
        p[at] *= self.g3[pair]
        i, found = _seek(self.tri, pair * v + z[at])
        found &= known[c[at]]
        p[at[found]] += self.p3[i[found]]
        return np.log(p)


def _seek(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``wanted`` in the sorted ``keys``, and which are there."""
    i = np.searchsorted(keys, wanted)
    i[i == len(keys)] = 0
    return i, (keys[i] == wanted if len(keys) else np.zeros(len(i), dtype=bool))


def _shares(n: np.ndarray, context: np.ndarray, contexts: int, cuts: list[float]) -> tuple[np.ndarray, np.ndarray]:
    """(discounted share of its context of every n-gram, the mass left over of every context; 1 where it was never met)."""
    cut = np.minimum(n, np.array([0.0, *cuts])[np.minimum(n, 3)])
    total, left = np.bincount(context, n, contexts), np.bincount(context, cut, contexts)
    return (n - cut) / total[context], np.divide(left, total, out=np.ones(contexts), where=total > 0)


def _met(n: np.ndarray) -> list[int]:
    return [int((n == i).sum()) for i in (1, 2, 3, 4)]


def _blocks(texts: DataFrame, chars: int) -> int:
    return max(BLOCKS, -(-(texts.agg(F.sum(F.length("text"))).first()[0] or 0) // chars))


def fit(texts: DataFrame, text: str = "text") -> KneserNey:
    """The model of ``texts``, which are written once.  NULL and empty texts are an empty sentence (the end mark alone)."""
    spark, texts = texts.sparkSession, stored(_prepared(texts, text))
    blocks = _blocks(texts, FIT_CHARS)
    home = _dealt(texts, blocks, False)
    mine = spark.createDataFrame(home.map(lambda x: (x[1][1],)), "piece binary")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = _Part([x for batch in batches for x in batch.column("piece").to_pylist()])
        c, n = np.unique(part.bi % max(len(part.words), 1), return_counts=True)
        met = [*_met(part.n), *_met(part.n2)]
        yield pa.RecordBatch.from_arrays([pa.array([0] * len(c) + list(range(1, 9)), pa.int32()), pa.array([*part.words[c].tolist(), *[0] * 8], pa.int64()),
                                          pa.array([*n.tolist(), *met], pa.int64())], names=["kind", "word", "n"])
    counts = mine.mapInArrow(count, "kind int, word bigint, n bigint").groupBy("kind", "word").agg(F.sum("n").alias("n")).toArrow()
    kind, word, n = (counts.column(c).to_numpy() for c in ("kind", "word", "n"))
    met = {k: v for k, v in zip(kind.tolist(), n.tolist(), strict=True) if k}
    d3, d2 = (discounts(*[met.get(i, 0) for i in at]) for at in (range(1, 5), range(5, 9)))
    word, n = word[kind == 0], n[kind == 0]
    order = np.argsort(word)
    word, n = word[order], n[order]
    # the empty context; one word more: those never met
    p, left = _shares(n, np.zeros(len(n), dtype=np.int64), 1, discounts(*_met(n)))
    rest = float(left[0]) / (len(n) + 1) if len(n) else 1.0
    return KneserNey(texts, home, blocks, d3, d2, word, p + rest, rest)


def score(model: KneserNey, texts: DataFrame, text: str = "text", keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """(keys, n_tokens, logp): the words of every text and its mean log-probability per word, the end mark included.

    ``keys`` is a key; texts of one key are one.  NULL and empty texts score as the end
    mark alone.  Words are known by 64-bit hashes; a text's trigrams are shuffled once,
    packed, and the words' shares (16 bytes a word) pass the driver to every task.
    """
    spark, texts = texts.sparkSession, _prepared(texts, text, F.struct(*keys).alias("key"))
    blocks, trained = _blocks(texts, BLOCK_CHARS), model.home
    if blocks > 2 * model.blocks:  # more to hold than the model was dealt for
        trained = _dealt(model.texts, blocks, False)
    else:
        blocks = model.blocks
    home = trained.union(_dealt(texts, blocks, True))
    if home.getNumPartitions() != trained.getNumPartitions():
        raise RuntimeError("blocks of the model and of the texts were dealt apart")
    d3, d2, rest = model.d3, model.d2, model.rest
    shares = spark.sparkContext.broadcast((model.words, model.shares))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(k, p) for batch in batches for k, p in zip(batch.column("keyed").to_pylist(), batch.column("piece").to_pylist(), strict=True)]
        part = _Part([p for k, p in rows if not k])
        part.model(d3, d2)
        for packed in (p for k, p in rows if k):
            packed_keys, grams = pickle.loads(packed)
            words, a, b, c, at = _unpack(grams)
            own, found = _seek(shares.value[0], words)
            own = np.where(found, shares.value[1][own], rest) if len(shares.value[0]) else np.full(len(words), rest)
            logp = part.find(words, a, b, c, own)
            at = np.cumsum(at)
            with pa.ipc.open_stream(zlib.decompress(packed_keys)) as stream:
                key = stream.read_all().combine_chunks().column("key").chunk(0)
            yield pa.RecordBatch.from_arrays([key, pa.array(np.bincount(at, minlength=len(key)), pa.int64()), pa.array(np.bincount(at, logp, len(key)))],
                                             names=["key", "n", "s"])
    pieces = spark.createDataFrame(home.map(lambda x: x[1]), "keyed boolean, piece binary")
    schema = StructType([texts.schema["key"], StructField("n", LongType()), StructField("s", DoubleType())])
    total = pieces.mapInArrow(look_up, schema).groupBy("key").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    return total.select(*[F.col("key")[c].alias(c) for c in keys], (F.col("n") - 1).alias("n_tokens"), (F.col("s") / F.col("n")).alias("logp"))
