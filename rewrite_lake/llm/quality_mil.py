"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words; only documents have labels.
Every passage is encoded from its bytes (frequencies of character class pairs,
word lengths, repeats), the encoder's gated attention weighs the passages,
``softmax(w . (tanh(V h) * sigmoid(U h)))``, and a logistic layer scores their
weighted sum.  All weights are learned together, from document labels only.

The model is fitted on at most ``FIT_DOCS`` labelled documents, those with the
least hash of their id; it scores every passage of every document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, read
from .hashing import chunks, word_hashes

#: Words of a passage; labelled documents fitted on, at most; passes over them.
PASSAGE, FIT_DOCS, EPOCHS, HIDDEN, GATE = 100, 3000, 25, 24, 12

_CLASSES = 13
_CLASS = np.zeros(256, dtype=np.int64)
for _c, _members in enumerate([b"", b"aeiouy", b"AEIOUY", b"BCDFGHJKLMNPQRSTVWXZ", b"0123456789", b" \t\r\v\f", b"\n", b".",
                               b",;:", b"!?", b"#*$%&<>|", b"\"'()[]{}-_/\\+=@^`~"]):
    _CLASS[list(_members)] = _c
_CLASS[list(b"bcdfghjklmnpqrstvwxz")] = 0
_CLASS[128:] = 12
N_FEATURES = _CLASSES * _CLASSES + 4


def passages(texts: list[bytes]) -> list[np.ndarray]:
    """Per text a matrix, one row of features per passage (at least one).

    Class pairs and three-word windows lie in one text, so its features are the
    same in any company.
    """
    out = []
    for group in chunks(texts):
        data = np.frombuffer(b" ".join(group) + b" ", dtype=np.uint8)
        words, first = word_hashes(group)
        kind = _CLASS[data]
        blank = (kind == 5) | (kind == 6)
        n_words = np.diff(first)
        n_pass = np.maximum(1, -(-n_words // PASSAGE))
        base = np.concatenate([[0], np.cumsum(n_pass)])
        lengths = np.array([len(t) + 1 for t in group])
        text = np.repeat(np.arange(len(group)), lengths)
        starts = np.concatenate([[not blank[0]], blank[:-1] & ~blank[1:]])
        number = np.cumsum(starts) - 1 - first[text]  # the word that a byte is in, or follows
        where = base[text] + np.clip(number, 0, None) // PASSAGE
        where = np.minimum(where, base[text + 1] - 1)
        total = int(base[-1])
        pair = kind[:-1] * _CLASSES + kind[1:]
        own = text[:-1] == text[1:]  # not the pair of a text's end and the next text's first byte
        counts = np.bincount((where[:-1] * (_CLASSES**2) + pair)[own], minlength=total * _CLASSES**2).reshape(total, -1).astype(np.float32)
        size = np.maximum(1, counts.sum(axis=1, keepdims=True))
        # words: of which passage, how many, how long, how many distinct, how many three-word windows seen before in the text
        w_text = np.repeat(np.arange(len(group)), n_words)
        w_pass = base[w_text] + (np.arange(len(words)) - first[w_text]) // PASSAGE
        n = np.maximum(1, np.bincount(w_pass, minlength=total))
        distinct = np.bincount(np.unique(np.stack([w_pass.astype(np.uint64), words]), axis=1)[0].astype(np.int64), minlength=total) if len(words) else n * 0
        rolled = words.copy()
        for j in (1, 2):
            rolled[:len(words) - j] = rolled[:len(words) - j] * np.uint64(0xD6E8FEB86659FD93) + words[j:]
        inside = np.flatnonzero(np.arange(len(words)) + 2 < first[w_text + 1])  # windows that end in their own text
        key = rolled[inside] ^ (w_text[inside].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        again = np.ones(len(inside), dtype=bool)
        again[np.unique(key, return_index=True)[1]] = False
        repeat = np.bincount(w_pass[inside[again]], minlength=total)
        extra = np.stack([np.log1p(n) / 5, np.bincount(where, weights=~blank, minlength=total) / n / 10,
                          distinct / n, repeat / n], axis=1).astype(np.float32)
        matrix = np.hstack([counts / size, extra])
        out += np.split(matrix, base[1:-1])
    return out


class AttentionModel:
    """Encoder, gated attention and logistic output, in plain arrays."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        scale = lambda a, b: rng.normal(0, 1 / np.sqrt(a), (a, b)).astype(np.float32)
        self.p = {"E": scale(N_FEATURES, HIDDEN), "e": np.zeros(HIDDEN, np.float32), "V": scale(HIDDEN, GATE), "U": scale(HIDDEN, GATE),
                  "w": scale(GATE, 1)[:, 0], "c": scale(HIDDEN, 1)[:, 0], "b": np.zeros(1, np.float32)}
        self.mean = np.zeros(N_FEATURES, np.float32)
        self.std = np.ones(N_FEATURES, np.float32)

    def forward(self, x: np.ndarray, bag: np.ndarray, n: int) -> dict:
        """All passages of ``n`` bags at once; ``bag`` says whose each is, ascending."""
        p = self.p
        x = (x - self.mean) / self.std
        h = np.tanh(x @ p["E"] + p["e"])
        t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        logit = (t * g) @ p["w"]
        first = np.searchsorted(bag, np.arange(n))
        logit = np.exp(logit - np.maximum.reduceat(logit, first)[bag])
        a = logit / np.add.reduceat(logit, first)[bag]
        z = np.add.reduceat(a[:, None] * h, first, axis=0)
        y = 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["b"], -30, 30)))
        return {"x": x, "h": h, "t": t, "g": g, "a": a, "z": z, "y": y, "first": first}

    def gradient(self, f: dict, bag: np.ndarray, label: np.ndarray) -> dict:
        p = self.p
        d = (f["y"] - label) / len(label)
        dz = d[:, None] * p["c"]
        da = (dz[bag] * f["h"]).sum(1)
        dh = f["a"][:, None] * dz[bag]
        ds = f["a"] * (da - np.add.reduceat(f["a"] * da, f["first"])[bag])
        dt = ds[:, None] * p["w"] * f["g"] * (1 - f["t"] ** 2)
        dg = ds[:, None] * p["w"] * f["t"] * f["g"] * (1 - f["g"])
        dh = (dh + dt @ p["V"].T + dg @ p["U"].T) * (1 - f["h"] ** 2)
        return {"E": f["x"].T @ dh + 1e-4 * p["E"], "e": dh.sum(0), "V": f["h"].T @ dt, "U": f["h"].T @ dg,
                "w": (f["t"] * f["g"]).T @ ds, "c": f["z"].T @ d + 1e-4 * p["c"], "b": np.array([d.sum()])}

    def fit(self, bags: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> AttentionModel:
        every = np.concatenate(bags)
        self.mean, self.std = every.mean(0), every.std(0) + np.float32(1e-3)
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(bags))
            for at in range(0, len(order), 64):
                some = order[at:at + 64]
                bag = np.repeat(np.arange(len(some)), [len(bags[i]) for i in some])
                grad = self.gradient(self.forward(np.concatenate([bags[i] for i in some]), bag, len(some)), bag, labels[some])
                step += 1
                for k, g in grad.items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v2[k] = 0.999 * v2[k] + 0.001 * g * g
                    self.p[k] = (self.p[k] - 0.003 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v2[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self

    def score(self, bags: list[np.ndarray]) -> np.ndarray:
        """Scores in double precision, to nine places: sums differ past those with the size of a batch."""
        bag = np.repeat(np.arange(len(bags)), [len(b) for b in bags])
        return np.round(self.forward(np.concatenate(bags).astype(float), bag, len(bags))["y"], 9)


def held_out(doc_id: Column) -> Column:
    """Whether a document's label is kept from the fit: crc32 of its id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
        fit_docs: int = FIT_DOCS) -> AttentionModel | float:
    """The model, or a constant score where the labels hold one class (0.5: none).

    Labels other than 0 and 1, null ids and ids with both labels are left out.
    The labels used are at most ``fit_docs``, so they are broadcast to the scan
    and only their documents' features reach the driver.
    """
    one = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    one = one.groupBy(F.col(id_col).alias("i")).agg(F.min(label_col).alias("y"), F.max(label_col).alias("y2")).where("y = y2")
    one = one.orderBy(F.xxhash64("i"), "i").limit(fit_docs).select("i", "y")

    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([x.astype(np.float32).tobytes() for x in passages([bytes(t) for t in batch])])
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    sample = docs.join(F.broadcast(one), F.col(id_col) == F.col("i")).groupBy("i", "y").agg(F.min(text).alias("t"))
    rows = sample.select("i", "y", F.pandas_udf(encode, "binary")("t").alias("x")).collect()
    rows.sort(key=lambda r: str(r["i"]))
    y = np.array([r["y"] for r in rows], dtype=np.float32)
    if len(set(y.tolist())) < 2:
        return float(y[0]) if len(y) else 0.5
    bags = [np.frombuffer(bytes(r["x"]), dtype=np.float32).reshape(-1, N_FEATURES) for r in rows]
    return AttentionModel().fit(bags, y)


def score(docs: DataFrame, model: AttentionModel | float, *, text_col: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with a score from 0 to 1, of the text alone.  Null and empty texts
    are one empty passage; repeated rows score alike, wherever they lie; an empty table stays empty; a clashing
    name gets underscores."""
    (out,) = fresh(docs, out)
    if not isinstance(model, AttentionModel):
        return docs.withColumn(out, F.lit(float(model)))

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            parts = [np.zeros(0)]
            for group in chunks([bytes(t) for t in batch]):
                parts.append(model.score(passages(group)))
            yield pd.Series(np.concatenate(parts))
    return docs.withColumn(out, F.pandas_udf(run, "double")(F.coalesce(F.col(text_col), F.lit("")).cast("binary")))


def op9_quality_mil(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, read(spark, sf_dir, "labels"))
    scored = score(docs, model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op9_quality_mil": op9_quality_mil}
ORACLE: dict[str, str] = {}
