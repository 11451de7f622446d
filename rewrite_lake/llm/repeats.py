"""Exact repeated-substring removal with suffix arrays over shared contexts.

A start is repeated if its 200-byte string also starts anywhere else in the
corpus.  Every start is dealt to an anchor, the least 32-byte hash inside its
string, so equal strings meet at equal anchors; neighbouring starts with one
anchor form a run, whose bytes are their common context.  Runs are narrowed in
steps, each one an aggregate or a join over rows of fixed size:

* a run whose anchor occurs once holds no repeat;
* runs equal as a whole are repeated as a whole, however many they are;
* only different contexts of one anchor need sorting.  Their bytes are fetched,
  cut to what another context can match, their shared core becomes one symbol,
  and a suffix array of the anchor's contexts (:mod:`suffix_array`) gives each
  start's longest match.  An anchor with more contexts than ``SORT_MOST`` is
  never brought into one task: its starts are counted by the hash of their
  string, all of them.

Texts are told apart by a 128-bit key of their bytes, so equal texts share one
answer and no row number has to survive a lost executor.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialize, read
from .hashing import mix, prefix_hash
from .suffix_array import neighbour_lcp, suffix_array

#: Bytes of a repeated string, of an anchor, and starts handled at once.
WINDOW, ANCHOR, PIECE = 200, 32, 1 << 19
#: Contexts of one anchor that one task sorts (6 MB of bytes, of which little is
#: left once each is cut to what another can match).
SORT_MOST = 16_384
_POSITION = np.uint64((1 << 24) - 1)


def window_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, by block prefixes and suffixes."""
    n = len(values) - width + 1
    pad = (-len(values)) % width
    full = np.concatenate([values, np.full(pad, np.iinfo(np.uint64).max, dtype=np.uint64)]).reshape(-1, width)
    left = np.minimum.accumulate(full, axis=1).ravel()
    right = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[width - 1:width - 1 + n])


def runs_of(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """(start, count, offset of the anchor, anchor hash, context hash) of the
    runs of ``data``, whose texts end at ``ends``; no string crosses an end."""
    empty = np.zeros(0, dtype=np.int64)
    if len(data) < WINDOW:
        return empty, empty, empty, empty, empty
    sums, down = prefix_hash(data)
    n = len(data) - ANCHOR + 1
    grams = mix((sums[ANCHOR:] - sums[:-ANCHOR]) * down[:n])
    # ordered by 40 bits of the hash, then by place: the leftmost of equal grams
    marked = (grams & ~_POSITION) | np.arange(n, dtype=np.uint64)
    anchor = (window_minimum(marked, WINDOW - ANCHOR + 1) & _POSITION).astype(np.int64)
    starts = np.arange(len(anchor))
    text = np.searchsorted(ends, starts, side="right")
    valid = starts + WINDOW <= ends[text]
    label = np.where(valid, anchor, -1)
    new = np.concatenate([[True], (label[1:] != label[:-1]) | (text[1:] != text[:-1])])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(label)))
    keep = label[first] >= 0
    first, count = first[keep], count[keep]
    at = label[first]
    stop = first + count - 1 + WINDOW
    context = mix((sums[stop] - sums[first]) * down[first] + count.astype(np.uint64))
    return first, count, at - first, grams[at].view(np.int64), context.view(np.int64)


def _all_runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(k1, k2, text) -> (k1, k2, at, anchor, context); ``at`` packs start, count and offset."""
    for pdf in batches:
        texts = [bytes(t) for t in pdf["text"]]
        k1, k2 = pdf["k1"].to_numpy(), pdf["k2"].to_numpy()
        # pieces: whole texts together, or parts of a long one, overlapping by a string less a byte
        group, size = [], 0

        def done(group):
            data = np.frombuffer(b"".join(t for _, _, t in group), dtype=np.uint8)
            lengths = np.array([len(t) for _, _, t in group])
            ends = np.cumsum(lengths)
            first, count, offset, anchor, context = runs_of(data, ends)
            of = np.searchsorted(ends, first, side="right")
            row = np.array([r for r, _, _ in group])[of] if len(first) else first
            start = first - (ends - lengths)[of] + np.array([a for _, a, _ in group])[of] if len(first) else first
            return pd.DataFrame({"k1": k1[row], "k2": k2[row], "at": (start << 16) | (count << 8) | offset,
                                 "anchor": anchor, "context": context})
        for r, text in enumerate(texts):
            for a in range(0, max(1, len(text) - WINDOW + 1), PIECE):
                part = text[a:a + PIECE + WINDOW - 1]
                if len(part) < WINDOW:
                    continue
                group.append((r, a, part))
                size += len(part)
                if size >= PIECE:
                    yield done(group)
                    group, size = [], 0
        if group:
            yield done(group)


def _shared(a: bytes, b: bytes) -> int:
    return len(os.path.commonprefix((a, b)))


def repeated_starts(contexts: list[bytes], offsets: list[int]) -> list[list[tuple[int, int]]]:
    """Per context: runs (start, count) of starts whose string occurs in another
    context too, aligned at the anchor.  All contexts are different."""
    found: list[list[tuple[int, int]]] = [[] for _ in contexts]
    right = [c[o:] for c, o in zip(contexts, offsets, strict=True)]
    left = [c[:o][::-1] for c, o in zip(contexts, offsets, strict=True)]

    def reach(parts, who):
        order = sorted(who, key=parts.__getitem__)
        near = [_shared(parts[a], parts[b]) for a, b in zip(order[:-1], order[1:], strict=True)]
        most = dict(zip(order, map(max, [0, *near], [*near, 0]), strict=True))
        return most, min(near, default=0)
    who = list(range(len(contexts)))
    while True:  # dropping a context may shorten what the others can reach
        r_most, r_core = reach(right, who)
        l_most, l_core = reach(left, who)
        stay = [i for i in who if r_most[i] + l_most[i] >= WINDOW]
        if len(stay) == len(who) or not stay:
            break
        who = stay
    if len(stay) < 2:
        return found
    core = l_core + r_core
    seq: list[int] = []
    begin, weight = {}, []
    for n, i in enumerate(who):
        begin[i] = len(seq)
        before = left[i][l_core:l_most[i]][::-1]
        after = right[i][r_core:r_most[i]]
        base = len(who)
        seq += [base + x for x in before] + [base + 256] + [base + x for x in after] + [n]  # the end is its own symbol
        weight += [1] * len(before) + [core] + [1] * (len(after) + 1)
    order = suffix_array(seq)
    lcp = neighbour_lcp(seq, order) + [0]
    upto = np.concatenate([[0], np.cumsum(weight)]).tolist()
    longest = [0] * len(seq)
    for at, p in enumerate(order):
        shared = max(lcp[at], lcp[at + 1])
        longest[p] = upto[p + shared] - upto[p]
    for i in who:
        first = offsets[i] - l_most[i]
        extra = l_most[i] - l_core
        runs = found[i]
        starts = [first + x for x in range(extra) if longest[begin[i] + x] >= WINDOW]
        inside = longest[begin[i] + extra] - WINDOW + 1
        starts += range(first + extra, first + extra + max(0, min(inside, core)))
        for s in starts:
            if runs and runs[-1][0] + runs[-1][1] == s:
                runs[-1] = (runs[-1][0], runs[-1][1] + 1)
            else:
                runs.append((s, 1))
    return found


def _sort_contexts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Contexts sorted by anchor -> (k1, k2, start, count) of repeats in those that occur once."""
    def solve(rows):
        out = []
        if len(rows) > 1:
            runs = repeated_starts([r[5] for r in rows], [r[3] & 255 for r in rows])
            for (_, k1, k2, at, n, _), found in zip(rows, runs, strict=True):
                if n == 1:
                    out += [(k1, k2, (at >> 16) + s, c) for s, c in found]
        return out
    rows: list[tuple] = []
    for pdf in batches:
        out = []
        for row in zip(*[pdf[c].tolist() for c in ("anchor", "k1", "k2", "at", "n", "bytes")], strict=True):
            if rows and rows[-1][0] != row[0]:
                out += solve(rows)
                rows = []
            rows.append((*row[:5], bytes(row[5])))
        yield pd.DataFrame(out, columns=["k1", "k2", "start", "count"])
    yield pd.DataFrame(solve(rows), columns=["k1", "k2", "start", "count"])


def _all_strings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Contexts -> one row per start: (s1, s2), a 128-bit hash of its string, and where it is."""
    for pdf in batches:
        for at in range(0, len(pdf), 1000):
            part = pdf.iloc[at:at + 1000]
            raw = [bytes(x) for x in part["bytes"]]
            data = np.frombuffer(b"".join(raw), dtype=np.uint8)
            lengths = np.array([len(x) for x in raw])
            begin = np.cumsum(lengths) - lengths
            m = lengths - WINDOW + 1
            row = np.repeat(np.arange(len(raw)), m)
            place = np.arange(len(row)) - np.repeat(np.cumsum(m) - m, m)  # of the start in its context
            first = begin[row] + place
            both = []
            for flip, salt in ((0, 0), (0x5A, 1)):
                sums, down = prefix_hash(data ^ np.uint8(flip))
                both.append(mix((sums[first + WINDOW] - sums[first]) * down[first] + np.uint64(salt)).view(np.int64))
            yield pd.DataFrame({"k1": part["k1"].to_numpy()[row], "k2": part["k2"].to_numpy()[row], "n": part["n"].to_numpy()[row],
                                "start": (part["at"].to_numpy()[row] >> 16) + place, "s1": both[0], "s2": both[1]})


def _keys(text: Column) -> list[Column]:
    return [F.xxhash64(F.lit(1), text).alias("k1"), F.xxhash64(F.lit(2), F.octet_length(text), text).alias("k2")]


def repeated_ranges(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(k1, k2, start, count): runs of repeated starts per distinct text."""
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    keyed = docs.where(F.octet_length(text) >= WINDOW).select(*_keys(text), text.alias("text"))
    runs = materialize(keyed.mapInPandas(_all_runs, "k1 long, k2 long, at long, anchor long, context long"), "runs")
    # written first, so that the join's sides are plain shuffles whose hot anchors can be split
    again = materialize(runs.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor"), "again")
    shared = materialize(runs.join(again, "anchor"), "shared")
    contexts = materialize(shared.groupBy("anchor", "context").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("k1", "k2", "at")).alias("one")), "contexts")
    equal = contexts.where("n > 1").select("anchor", "context")
    whole = shared.join(equal, ["anchor", "context"]).select(
        "k1", "k2", F.shiftright("at", 16).alias("start"), F.shiftright("at", 8).bitwiseAND(F.lit(255)).alias("count")).distinct()
    several = materialize(contexts.groupBy("anchor").agg(F.count(F.lit(1)).alias("m")).where("m > 1"), "several")
    wanted = contexts.join(several, "anchor").select("anchor", "n", "m", "one.k1", "one.k2", "one.at")
    # one of equal texts is enough, and any is as good: the key is of the bytes
    start, count = F.shiftright("at", 16), F.shiftright("at", 8).bitwiseAND(F.lit(255))
    cut = F.substring(F.col("text"), (start + 1).cast("int"), (count + WINDOW - 1).cast("int"))
    fetched = keyed.join(wanted, ["k1", "k2"]).select("anchor", "n", "m", "k1", "k2", "at", cut.alias("bytes"))
    fetched = materialize(fetched.dropDuplicates(["anchor", "k1", "k2", "at"]), "fetched")
    few = fetched.where(F.col("m") <= SORT_MOST).repartition("anchor").sortWithinPartitions("anchor")
    sorted_ = few.select("anchor", "k1", "k2", "at", "n", "bytes").mapInPandas(
        _sort_contexts, "k1 long, k2 long, start long, count long")
    strings = materialize(fetched.where(F.col("m") > SORT_MOST).mapInPandas(
        _all_strings, "k1 long, k2 long, n long, start long, s1 long, s2 long"), "strings")
    twice = strings.groupBy("s1", "s2").agg(F.sum("n").alias("t")).where("t > 1").select("s1", "s2")
    counted = strings.where("n = 1").join(twice, ["s1", "s2"]).select("k1", "k2", "start", F.lit(1).cast("long").alias("count"))
    return materialize(whole.union(sorted_).union(counted), "ranges")


def _cut(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    """Text and its repeated starts -> spans removed and the bytes kept (null text: nothing to do)."""
    for texts, starts, counts in batches:
        out = []
        for text, start, count in zip(texts, starts, counts, strict=True):
            if text is None:
                out.append((None, None))
                continue
            text = bytes(text)
            order = np.argsort(np.asarray(start, dtype=np.int64), kind="stable")
            a = np.asarray(start, dtype=np.int64)[order]
            b = np.maximum.accumulate(a + np.asarray(count, dtype=np.int64)[order] - 1 + WINDOW)
            new = np.concatenate([[True], a[1:] > b[:-1]])
            a, b = a[new], b[np.append(np.flatnonzero(new)[1:] - 1, len(b) - 1)]
            edges = [0, *np.stack([a, b], axis=1).ravel().tolist(), len(text)]
            kept = b"".join(text[x:y] for x, y in zip(edges[0::2], edges[1::2], strict=True))
            out.append(([{"start": x, "end": y} for x, y in zip(a.tolist(), b.tolist(), strict=True)], kept))
        yield pd.DataFrame(out, columns=["spans", "kept"])


def remove_repeats(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """``docs`` with spans (removed byte ranges, end exclusive) and kept (bytes).

    Every byte of a 200-byte string that also starts elsewhere goes, all copies
    alike.  A null text is empty; texts under 200 bytes, blank or not, are kept;
    repeated rows are repeats of each other; an empty table gives no rows.
    Clashing names get underscores.
    """
    spans, kept = fresh(docs, "spans", "kept")
    (k1, k2, raw, starts, got) = fresh(docs, "k1", "k2", "raw", "ranges", "got")
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    ranges = repeated_ranges(docs, text_col).distinct().groupBy("k1", "k2").agg(
        F.collect_list("start").alias("s"), F.collect_list("count").alias("c")).select(
        F.col("k1").alias("j1"), F.col("k2").alias("j2"), F.struct("s", "c").alias(starts))
    keyed = docs.select("*", text.alias(raw), *[k.alias(n) for k, n in zip(_keys(text), (k1, k2), strict=True)])
    joined = keyed.join(ranges, (F.col(k1) == F.col("j1")) & (F.col(k2) == F.col("j2")), "left")
    cut = F.pandas_udf(_cut, "struct<spans:array<struct<start:bigint,end:bigint>>,kept:binary>")
    out = joined.withColumn(got, cut(F.when(F.col(starts).isNotNull(), F.col(raw)), F.col(starts)["s"], F.col(starts)["c"]))
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], F.coalesce(F.col(got)["spans"], none).alias(spans),
                      F.coalesce(F.col(got)["kept"], F.col(raw)).alias(kept))


def op7_repeat_removal(spark, sf_dir):
    out = remove_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"))
    size = F.octet_length(F.coalesce("text", F.lit(""))).cast("long")
    return out.select("doc_id", size.alias("n_bytes"), (size - F.octet_length("kept")).alias("n_removed"),
                      F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op7_repeat_removal": op7_repeat_removal}
ORACLE: dict[str, str] = {}
