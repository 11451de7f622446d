"""Personal data by pattern, and by a skip-chain conditional random field.

Patterns find the base spans.  What looks like such data but matches no pattern
(a phone number without its plus, a card written with dots) is decided by a
random field over the document's *units*: runs of digits and their separators,
and words with an at sign.  Every other word can't be an entity; in the chain it
is observed as none, so between units it only adds to the unit's own potential.

* Unit potentials: a maximum-entropy model of the unit's shape and neighbours.
* Chain potentials: directly neighbouring units; label pairs as counted.
* Skip potentials: units with equal or similar keys (same digits, same last ten
  digits, same address), however far apart; each is linked to the one before it,
  and agreement is worth what it was in the corpus.

Units under a base span are observed; loopy sum-product message passing carries
their labels to the others.  A unit's own potential is clipped, so shape alone
never makes a span: an added span needs repeats that agree, observed or not.

The model is fitted on label counts of all documents, by shape; the patterns
are the teachers, and no pattern match is a feature.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialize, read

KINDS = ("email", "ip", "card", "phone")
#: Label 0 is no entity; label k is KINDS[k - 1].
N_LABELS = 1 + len(KINDS)
#: Log odds that a unit's shape alone may give, posterior an added span needs,
#: rounds of message passing at most, and their damping.
CLIP, POSTERIOR, ROUNDS, DAMPING = 1.0, 0.9, 30, 0.3
#: Digits that a number unit needs to be considered.
MIN_DIGITS = 7

_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_NUMBER = re.compile(r"[+(]?[0-9](?:[0-9().-]| (?=[(0-9]))*[0-9]")
_ADDRESS = re.compile(r"[^\x20\x09-\x0D@]*@[^\x20\x09-\x0D]*")
_DIGITS = re.compile(r"[^0-9]+")
_ANY = re.compile(r"[0-9@]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """By at sign: the local part is the run of its characters up to there, not
    before the last match's end; so a long run is read once."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at) if start < at else None
        if found:
            yield start, found.end()
            last = found.end()
        # a sign inside what was matched can't occur: it is in no class
        at = text.find("@", max(at + 1, last))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end), ordered by start, then kind as listed."""
    out = [(a, 0, b) for a, b in _emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(map(_small, m[0].split("."))):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = _DIGITS.sub("", m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_DIGITS.sub("", m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def _shape(unit: str) -> int:
    """A unit's features, packed: sign, digits, dots, other separators, letters, length."""
    digits = sum(c.isdigit() for c in unit)
    return (("@" in unit) | (unit[0] == "+") << 1 | min(digits, 20) << 2 | min(unit.count("."), 4) << 7
            | ("(" in unit) << 10 | min(unit.count("-"), 4) << 11 | min(unit.count(" "), 4) << 14
            | any(c.isalpha() for c in unit) << 17 | min(len(unit) // 8, 7) << 18)


def features(shape: int) -> np.ndarray:
    """Indicator vector of a packed shape."""
    out = np.zeros(59)
    out[0] = 1
    out[1] = shape & 1
    out[2] = shape >> 1 & 1
    out[3 + (shape >> 2 & 31)] = 1
    out[24 + (shape >> 7 & 7)] = 1
    out[30] = shape >> 10 & 1
    out[31 + (shape >> 11 & 7)] = 1
    out[38 + (shape >> 14 & 7)] = 1
    out[45] = shape >> 17 & 1
    out[46 + (shape >> 18 & 7)] = 1
    return out


def units_of(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, str, str, bool]]:
    """(start, end, observed label or 0, shape, key, short key, joins the one before) in order."""
    found = [(m.start(), m.end()) for m in _NUMBER.finditer(text)] if _ANY.search(text) else []
    if "@" in text:
        mails = [(m.start(), m.end()) for m in _ADDRESS.finditer(text)]
        found = sorted(mails + [n for n in found if not any(a < n[1] and n[0] < b for a, b in _near(mails, n))])
    out, s, last = [], 0, -2
    for a, b in found:
        unit = text[a:b]
        digits = _DIGITS.sub("", unit)
        if "@" in unit:
            key = short = unit.strip(".,;:!?()<>\"'").lower()
        elif len(digits) >= MIN_DIGITS:
            key, short = digits, digits[-10:]
        else:
            continue
        while s < len(spans) and spans[s][2] <= a:
            s += 1
        label = next((k + 1 for x, k, y in spans[s:s + 4] if x < b and a < y), 0)
        out.append((a, b, label, _shape(unit), key, short, a - last <= 1))
        last = b
    return out


def _near(mails, n):
    """The addresses that may overlap a number (both lists are in order)."""
    import bisect
    k = bisect.bisect_left(mails, (n[1],))
    return mails[max(0, k - 1):k]


_UNIT = "struct<start:bigint,end:bigint,label:int,shape:int,key:string,short:string,joined:boolean>"
_FOUND = f"struct<base:array<struct<start:bigint,k:int,end:bigint>>,units:array<{_UNIT}>>"
_NAMES = ["start", "end", "label", "shape", "key", "short", "joined"]


def _find(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        base, units = [], []
        for text in batch:
            if text is None or not _ANY.search(text):
                base.append([])
                units.append([])
                continue
            spans = base_spans(text)
            base.append([{"start": a, "k": k, "end": b} for a, k, b in spans])
            units.append([dict(zip(_NAMES, u, strict=True)) for u in units_of(text, spans)])
        yield pd.DataFrame({"base": base, "units": units})


def skip_edges(units: list[dict]) -> list[tuple[int, int]]:
    """Each unit with the one before it of equal key, or else of equal short key."""
    edges, by_key, by_short = [], {}, {}
    for i, u in enumerate(units):
        j = by_key.get(u["key"], by_short.get(u["short"]))
        if j is not None:
            edges.append((j, i))
        by_key[u["key"]] = by_short[u["short"]] = i
    return edges


class Model:
    """Potentials: ``shape`` -> log potential of each label, chain and skip matrices."""

    def __init__(self, weights: np.ndarray, chain: np.ndarray, skip: float):
        self.weights, self.chain, self.skip = weights, chain, skip
        self._unary: dict[int, np.ndarray] = {}

    def unary(self, shape: int) -> np.ndarray:
        got = self._unary.get(shape)
        if got is None:
            score = features(shape) @ self.weights
            got = self._unary[shape] = np.clip(score - score[0], -CLIP, CLIP)
        return got

    def marginals(self, units: list[dict]) -> np.ndarray:
        """Loopy sum-product over the document's units; observed ones are fixed."""
        n = len(units)
        local = np.empty((n, N_LABELS))
        for i, u in enumerate(units):
            if u["label"]:
                local[i] = -50
                local[i, u["label"]] = 0
            else:
                # a neighbour that is no unit is observed as none
                local[i] = self.unary(u["shape"]) + self.chain[0] * (not u["joined"]) + self.chain[:, 0] * (
                    i + 1 >= n or not units[i + 1]["joined"])
        skip = np.eye(N_LABELS) * self.skip
        pairs = [(i, j, skip) for i, j in skip_edges(units)]
        pairs += [(i - 1, i, self.chain) for i in range(1, n) if units[i]["joined"]]
        if pairs:
            src = np.array([p for i, j, _ in pairs for p in (i, j)])
            dst = np.array([p for i, j, _ in pairs for p in (j, i)])
            table = np.exp(np.array([m for _, _, t in pairs for m in (t, t.T)]))
            back = np.arange(len(src)) ^ 1
            message = np.zeros((len(src), N_LABELS))
            for _ in range(ROUNDS):
                belief = local.copy()
                np.add.at(belief, dst, message)
                out = belief[src] - message[back]
                out = np.exp(out - out.max(axis=1, keepdims=True))
                new = np.log(np.einsum("el,elm->em", out, table) + 1e-30)
                new -= new.max(axis=1, keepdims=True)
                moved = np.abs(new - message).max()
                message = DAMPING * message + (1 - DAMPING) * new
                if moved < 1e-4:
                    break
            np.add.at(local, dst, message)
        p = np.exp(local - local.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)


def fit(found: DataFrame) -> Model:
    """The model from counts over all documents: (shape, label) pairs, label
    pairs of neighbours, and agreement of units with one key.

    What reaches the driver is counts by packed shape: at most as many rows as
    there are shapes and labels, whatever the data.
    """
    each = found.select(F.explode("units").alias("u"))
    shapes = each.groupBy("u.shape", "u.label").agg(F.count(F.lit(1)).alias("n")).collect()
    x = np.array([features(r["shape"]) for r in shapes]).reshape(-1, 59)
    y = np.array([r["label"] for r in shapes], dtype=int)
    n = np.array([r["n"] for r in shapes], dtype=float)
    weights = np.zeros((59, N_LABELS))
    if len(shapes):
        n = n / n.sum()
        goal = np.eye(N_LABELS)[y]
        m, v = np.zeros_like(weights), np.zeros_like(weights)
        for step in range(1, 401):  # Adam on the weighted likelihood, small ridge
            s = x @ weights
            p = np.exp(s - s.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            g = x.T @ (n[:, None] * (p - goal)) + 1e-5 * weights
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            weights -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    units = F.col("units")
    joined = F.transform(F.filter(F.sequence(F.lit(1), F.size(units) - 1), lambda i: F.get(units, i)["joined"]),
                         lambda i: F.struct(F.get(units, i - 1)["label"].alias("a"), F.get(units, i)["label"].alias("b")))
    chains = found.where(F.size(units) > 1).select(F.explode(joined).alias("p")).groupBy("p.a", "p.b").agg(
        F.count(F.lit(1)).alias("n")).collect()
    count = np.ones((N_LABELS, N_LABELS))
    for r in chains:
        count[r["a"], r["b"]] += r["n"]
    p = count / count.sum()
    chain = np.clip(np.log(p) - np.log(p.sum(1, keepdims=True)) - np.log(p.sum(0, keepdims=True)), -2, 2)
    chain -= chain[0, 0]  # none beside none is the norm
    chain[0], chain[:, 0] = np.clip(chain[0], -0.25, 0.25), np.clip(chain[:, 0], -0.25, 0.25)
    labels = F.transform(F.filter(units, lambda u: u["label"] > 0), lambda u: F.struct(u["short"].alias("key"), u["label"].alias("label")))
    pairs = found.where(F.size(units) > 1).select(F.transform(F.array_distinct(labels), lambda u: u["key"]).alias("d"),
                                                  F.size(labels).alias("all"), F.size(F.array_distinct(F.transform(labels, lambda u: u["key"]))).alias("keys"))
    # of equally keyed observed units, those whose labels differ are the extra distinct (key, label) pairs
    agree = pairs.select(F.sum(F.col("all") - F.col("keys")).alias("n"), F.sum(F.size("d") - F.col("keys")).alias("off")).first()
    n_pairs, off = float(agree["n"] or 0), float(agree["off"] or 0)
    skip = float(np.log((n_pairs - off + 20) / (off + 0.25)))
    return Model(weights, chain, min(max(skip, 0.0), 5.0))


def _decide(model: Model):
    @F.pandas_udf("array<struct<start:bigint,k:int,end:bigint>>")
    def decide(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            out = []
            for units in batch:
                units = [dict(zip(_NAMES, (u[c] for c in _NAMES), strict=True)) for u in (units if units is not None else [])]
                if not units or all(u["label"] for u in units):
                    out.append([])
                    continue
                p = model.marginals(units)
                best = p.argmax(axis=1)
                out.append([{"start": u["start"], "k": int(best[i]) - 1, "end": u["end"]} for i, u in enumerate(units)
                            if not u["label"] and best[i] and p[i, best[i]] >= POSTERIOR])
            yield pd.Series(out)
    return decide


def join_spans(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["k"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_pii(docs: DataFrame, *, text_col: str = "text", keep=("doc_id",)) -> DataFrame:
    """The columns ``keep``, base (pattern spans) and added (by the field), in code points.

    A null or empty text has none; repeated rows get equal spans; an empty table
    gives no rows; other columns of ``docs`` are ignored.  The field decides in
    every document with units, whether a pattern matched in it or not.
    """
    found = materialize(docs.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)],
                                    F.pandas_udf(_find, _FOUND)(F.col(text_col)).alias("f")).select(
        *[f"k{i}" for i in range(len(keep))], "f.base", "f.units"), "pii")
    model = fit(found)
    added = _decide(model)(F.col("units"))
    return found.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "base", added.alias("added"))


def mask_pii(docs: DataFrame, *, text_col: str = "text", out: str = "masked") -> DataFrame:
    """``docs`` with the text's base spans replaced by ``<KIND>`` (row by row, no field)."""
    (out,) = fresh(docs, out)

    @F.pandas_udf("string")
    def mask(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            rows = []
            for text in batch:
                parts, at = [], 0
                for a, k, b in base_spans(text) if text is not None else []:
                    if a >= at:
                        parts += [text[at:a], f"<{KINDS[k].upper()}>"]
                    at = max(at, b)
                rows.append(None if text is None else "".join(parts) + text[at:])
            yield pd.Series(rows, dtype=object)
    return docs.withColumn(out, mask(F.col(text_col)))


def op6_pii_crf(spark, sf_dir):
    found = find_pii(read(spark, sf_dir, "documents").select("doc_id", "text"))
    every = F.sort_array(F.concat("base", "added"))
    count = lambda k: F.size(F.filter("base", lambda s: s["k"] == k)).cast("long")
    return found.select("doc_id", *[count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)],
                        F.sha2(join_spans(F.col("base")), 256).alias("base_sha256"), join_spans(every).alias("spans"),
                        F.size("added").cast("long").alias("n_added"))


QUERIES = {"op6_pii_crf": op6_pii_crf}
ORACLE: dict[str, str] = {}
