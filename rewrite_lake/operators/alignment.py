"""A generator learnt from the pairs (UDF-05): word alignment and K-best rewrites.

:func:`align_words` estimates ``p(target word | source word)`` from (source,
target) pairs by expectation maximisation.  :func:`word_options` keeps each word's
likely targets, and :func:`rewrites` gives the ``k`` cheapest rewrites of every
sample, whose place is the ``candidate_rank`` that the rerank expects.

The words of one pair meet each other (that is what an alignment is), but no
table holds their meetings.  What a round shares out for a target word depends on
that word's column of the table alone, and on one total for each source word.  So
target words are dealt over blocks, each with the source words of the pairs that
have one of its words, once; a block makes its columns anew in every round, and
only totals (one number a source word) are written and handed back.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator, Sequence
from heapq import nsmallest

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from ..functions.text import empty_if_null, split_ws
from ..session import stored

#: Costs are whole millionths of a nat, so sums are exact and ties are ties.
COST_SCALE = 1_000_000
#: A word's targets: at least this likely, at most so many.
MIN_PROB, TOP = 0.05, 4
#: Meetings of words: in a block about, and held at a time.  Blocks at least (each can be one task).
BLOCK_CELLS, CELLS, BLOCKS = 1 << 26, 1 << 21, 8
#: A chunk of samples that ask for options together is 2**CHUNK rows of a task.
CHUNK = 14


def _hashes(words: str) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _counted(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words, row, word, count): the distinct words of all lists, and every list's distinct words by place among them."""
    values = lists.flatten().to_numpy(zero_copy_only=False)
    sizes = np.diff(lists.offsets.to_numpy())
    words, at = np.unique(values, return_inverse=True)
    cells, count = np.unique(np.repeat(np.arange(len(sizes)), sizes) * max(len(words), 1) + at, return_counts=True)
    return words, cells // max(len(words), 1), cells % max(len(words), 1), count


def _deal(batches: Iterator[pa.RecordBatch], blocks: int) -> Iterator[pa.RecordBatch]:
    """Rows of (src, tgt), lists of hashes -> (block, piece): a piece has some targets and the bags of their sources."""
    for batch in batches:
        texts: dict[bytes, int] = {}  # pairs with one source share its bag
        src = batch.column("src")
        ends, flat = src.offsets.to_numpy(), src.values.to_numpy(zero_copy_only=False)
        bag_of = np.array([texts.setdefault(flat[a:b].tobytes(), len(texts)) for a, b in zip(ends[:-1], ends[1:], strict=True)], dtype=np.int64)
        first = np.unique(bag_of, return_index=True)[1] if len(bag_of) else bag_of
        words, bag, word, count = _counted(src.take(pa.array(first)))
        lens = np.bincount(bag, minlength=len(first))
        starts = np.cumsum(lens) - lens
        targets, row, target, times = _counted(batch.column("tgt"))
        home = (targets.view(np.uint64) % np.uint64(blocks)).astype(np.int64)[target]
        for block in np.unique(home).tolist():
            mine = np.flatnonzero(home == block)
            mine = mine[np.argsort(target[mine], kind="stable")]
            bags, which = np.unique(bag_of[row[mine]], return_inverse=True)
            at = _ranges(starts[bags], lens[bags])
            vocabulary, s = np.unique(word[at], return_inverse=True)
            named, n = np.unique(target[mine], return_counts=True)
            piece = (words[vocabulary], lens[bags].astype(np.int32), np.diff(s, prepend=0).astype(np.int32), count[at].astype(np.int32),
                     targets[named], n.astype(np.int32), which.astype(np.int32), times[mine].astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([zlib.compress(pickle.dumps(piece), 1)], pa.binary())],
                                             names=["block", "piece"])


def _ranges(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The places of all ranges, one after the other."""
    return np.repeat(starts - (np.cumsum(lens) - lens), lens) + np.arange(int(lens.sum()))


class _Block:
    """Targets with the bags of the sources they were met with."""

    def __init__(self, pieces: list[bytes]):
        parts = [pickle.loads(zlib.decompress(x)) for x in pieces]
        self.words = np.unique(np.concatenate([x[0] for x in parts]))
        self.lens = np.concatenate([x[1] for x in parts]).astype(np.int64)
        self.starts = np.cumsum(self.lens) - self.lens
        self.s = np.concatenate([np.searchsorted(self.words, x[0])[np.cumsum(x[2], dtype=np.int64)].astype(np.int32) for x in parts])
        self.c = np.concatenate([x[3] for x in parts])
        self.size = np.add.reduceat(self.c, self.starts).astype(float)  # every source has the empty word
        bags = np.cumsum([0] + [len(x[1]) for x in parts])
        t = np.concatenate([np.repeat(x[4], x[5]) for x in parts])
        order = np.argsort(t, kind="stable")
        self.t = t[order]
        self.bag = np.concatenate([x[6].astype(np.int64) + b for x, b in zip(parts, bags[:-1], strict=True)])[order]
        self.times = np.concatenate([x[7] for x in parts])[order].astype(float)

    def _slices(self, a: int, b: int) -> Iterator[tuple[int, int]]:
        """Runs of the entries from ``a`` to ``b`` with about ``CELLS`` meetings each."""
        ends = np.cumsum(self.lens[self.bag[a:b]])
        while a < b:
            done = ends[len(ends) - (b - a) - 1] if b - a < len(ends) else 0
            to = max(a + 1, b - len(ends) + int(np.searchsorted(ends, done + CELLS, side="right")))
            yield a, min(to, b)
            a = min(to, b)

    def _columns(self, runs: list[tuple[int, int]], cell, n: int, totals: list[np.ndarray], rounds: int, of_cell) -> np.ndarray:
        """What each cell is given in the last of ``rounds``; ``cell`` numbers the meetings of a run."""
        e = p = None
        for r in range(rounds):
            if r:
                p = e / totals[r - 1][of_cell]
            e = np.zeros(n)
            for run in runs:
                bag, times, lens = self.bag[run[0]:run[1]], self.times[run[0]:run[1]], self.lens[self.bag[run[0]:run[1]]]
                at = _ranges(self.starts[bag], lens)
                where = cell(run, at)
                mass = self.c[at].astype(float)
                if r:
                    mass *= p[where]
                    sums = np.add.reduceat(mass, np.cumsum(lens) - lens)
                else:  # all ways are alike
                    sums = self.size[bag]
                e += np.bincount(where, mass * np.repeat(times / sums, lens), n)
        return e

    def columns(self, totals: list[np.ndarray], rounds: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(place of the source word, target, what the last round gives): every cell of the block once."""
        names, begins = np.unique(self.t, return_index=True)
        ends = np.append(begins[1:], len(self.t))
        cells = np.add.reduceat(self.lens[self.bag], begins)
        many = cells >= min(max(len(self.words) // 2, 1 << 12), CELLS)
        everywhere = np.arange(len(self.words))
        for name, a, b in zip(names[many].tolist(), begins[many].tolist(), ends[many].tolist(), strict=True):
            met = np.zeros(len(self.words), dtype=bool)
            runs = list(self._slices(a, b))
            for x, y in runs:
                met[self.s[_ranges(self.starts[self.bag[x:y]], self.lens[self.bag[x:y]])]] = True
            e = self._columns(runs, lambda run, at: self.s[at], len(self.words), totals, rounds, everywhere)
            s = np.flatnonzero(met)
            yield s, np.full(len(s), name, dtype=np.int64), e[s]
        few = np.flatnonzero(~many)
        sums = np.cumsum(cells[few])
        while len(few):
            n = max(1, int(np.searchsorted(sums, CELLS, side="right")))
            entries = _ranges(begins[few[:n]], ends[few[:n]] - begins[few[:n]])
            part = self._only(entries)
            which = np.repeat(np.arange(n), ends[few[:n]] - begins[few[:n]])
            lens = part.lens[part.bag]
            key = np.repeat(which, lens) * len(self.words) + part.s[_ranges(part.starts[part.bag], lens)]
            found, where = np.unique(key, return_inverse=True)
            s = found % len(self.words)
            e = part._columns([(0, len(entries))], lambda run, at, where=where: where, len(found), totals, rounds, s)
            yield s, names[few[:n]][found // len(self.words)], e
            few, sums = few[n:], sums[n:] - sums[n - 1]

    def _only(self, entries: np.ndarray) -> _Block:
        part = object.__new__(_Block)
        part.__dict__.update(self.__dict__, t=self.t[entries], bag=self.bag[entries], times=self.times[entries])
        return part


def align_words(pairs: DataFrame, source: str = "input", target: str = "target", ids: Sequence[str] = ("pair_id",),
                rounds: int = 3) -> DataFrame:
    """(s, t, p): ``p(t | s)`` after ``rounds`` of expectation maximisation from a uniform start.

    Words are whitespace tokens; the empty word ``''`` stands beside every source
    for targets without an origin.  ``ids`` is a key of one or several columns, nulls
    included; pairs of one key are one pair.  Null texts have no words; a pair without
    target words adds nothing.  Words are known by 64-bit hashes until the end.  The
    pairs' words are written once and shuffled once, to the blocks of their targets;
    the totals of a round (one a source word) pass the driver to every task.
    """
    spark = pairs.sparkSession
    source = F.concat(F.array(F.lit("")), split_ws(empty_if_null(source)))
    keyed = stored(pairs.select(F.struct(*ids).alias("__k"), source.alias("src"), split_ws(empty_if_null(target)).alias("tgt")))
    twice = stored(keyed.groupBy("__k").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("__k"))
    one = keyed
    if not twice.isEmpty():
        same = keyed.join(twice, "__k").groupBy("__k").agg(*[F.flatten(F.collect_list(c)).alias(c) for c in ("src", "tgt")])
        one = keyed.join(twice, "__k", "left_anti").unionByName(same)
    named = stored(keyed.select(F.explode(F.concat("src", "tgt")).alias("word")).distinct().select(F.xxhash64("word").alias("h"), "word"))
    cells = keyed.agg(F.sum(F.size("src").cast("bigint") * F.size("tgt"))).first()[0] or 0
    blocks = max(BLOCKS, -(-cells // BLOCK_CELLS))
    dealt = one.select(_hashes("src").alias("src"), _hashes("tgt").alias("tgt")).mapInArrow(
        lambda batches: _deal(batches, blocks), "block int, piece binary")
    # the pieces are shuffled here, once for all rounds
    home = dealt.rdd.map(lambda r: (r["block"], bytes(r["piece"]))).partitionBy(blocks, lambda block: block)
    pieces = spark.createDataFrame(home.map(lambda x: (x[1],)), "piece binary")
    known: list[np.ndarray] = []

    def run(last: bool):
        totals = spark.sparkContext.broadcast(known)
        done = max(len(known) - 1, 0) + (not last)

        def columns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            mine = [x for batch in batches for x in batch.column("piece").to_pylist()]
            if not mine:
                return
            block = _Block(mine)
            at = [np.searchsorted(totals.value[0], block.words)] if totals.value else []
            sums = [x[at[0]] for x in totals.value[1:]]
            total = np.zeros(len(block.words))
            for s, t, e in block.columns(sums, done):
                if last:
                    yield pa.RecordBatch.from_arrays([pa.array(block.words[s]), pa.array(t), pa.array(e / sums[-1][s])], names=["s", "t", "p"])
                else:
                    np.add.at(total, s, e) if len(s) < 1 << 10 else np.add(total, np.bincount(s, e, len(total)), out=total)
            if not last:
                yield pa.RecordBatch.from_arrays([pa.array(block.words), pa.array(total)], names=["s", "e"])
        return pieces.mapInArrow(columns, "s bigint, t bigint, p double" if last else "s bigint, e double")

    for _ in range(rounds):
        sums = run(False).groupBy("s").agg(F.sum("e").alias("e")).toArrow()
        s, e = (sums.column(c).to_numpy() for c in ("s", "e"))
        order = np.argsort(s)
        known = [s[order], *known[1:], e[order]]
    ends = [named.select(F.col("h").alias(c), F.col("word").alias(f"{c}_word")) for c in ("s", "t")]
    return run(True).join(ends[0], "s").join(ends[1], "t").select(F.col("s_word").alias("s"), F.col("t_word").alias("t"), "p")


def word_options(trans: DataFrame, min_prob: float = MIN_PROB, top: int = TOP) -> DataFrame:
    """(s, options): a word's targets with ``p >= min_prob``, the ``top`` likeliest (ties by
    target) with whole costs.  Fewer than ``1 / min_prob`` rows of a word are ranked."""
    p = F.round("p", 9)
    likely = trans.where((F.col("s") != "") & (p >= min_prob)).select(
        "s", "t", p.alias("p"), F.round(-F.log(p) * COST_SCALE).cast("bigint").alias("cost"))
    rank = F.row_number().over(Window.partitionBy("s").orderBy(F.col("p").desc(), "t")) - 1
    ranked = likely.withColumn("rank", rank).where(F.col("rank") < top)
    return ranked.groupBy("s").agg(F.sort_array(F.collect_list(F.struct("rank", "cost", F.col("t").alias("target")))).alias("options"))


def k_best(options: Sequence[Sequence[int]], k: int) -> list[list[int]]:
    """The ``k`` cheapest ways to choose one option at every place.

    ``options[i]`` are a place's costs, the first its cheapest.  Ties: fewer places off
    their first option, then the earlier place, then the earlier option.  That
    order holds for beginnings too, so a beam of ``k`` loses nothing.
    """
    beam: list[tuple[int, int, tuple, list[int]]] = [(0, 0, (), [])]
    for place, costs in enumerate(options):
        wider = [(c + cost, off + (o > 0), devs + (((place, o),) if o else ()), chosen + [o])
                 for c, off, devs, chosen in beam for o, cost in enumerate(costs[:k])]
        beam = sorted(wider)[:k]
    return [chosen for *_, chosen in beam]


def cheapest(lists: Sequence[Sequence[int]], k: int) -> list[list[tuple[int, int]]]:
    """:func:`k_best` as the (place, option) where a way leaves the first option, in order.

    A way with a single change that is not among the ``k - 1`` cheapest ones comes after
    all of them and after the way without changes, so no other places are tried.
    """
    singles = nsmallest(k - 1, [(cost - costs[0], i, o) for i, costs in enumerate(lists) for o, cost in enumerate(costs[1:k], 1)])
    tried = sorted({i for _, i, _ in singles})
    return [[(i, o) for i, o in zip(tried, way, strict=True) if o] for way in k_best([lists[i] for i in tried], k)]


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(chunk, s): the different words of the lines of a chunk."""
    for batch in batches:
        words: dict[int, set[str]] = {}
        for chunk, text in zip(batch.column("chunk").to_pylist(), batch.column("text").to_pylist(), strict=True):
            words.setdefault(chunk, set()).update(text.split(" "))
        for chunk, mine in words.items():
            yield pa.RecordBatch.from_arrays([pa.array([chunk] * len(mine), pa.int64()), pa.array(list(mine), pa.string())], names=["chunk", "s"])


def _in_chunks(samples: DataFrame) -> DataFrame:
    return stored(samples.withColumn("chunk", F.shiftright(F.monotonically_increasing_id(), CHUNK)))


def rewrites(samples: DataFrame, options: DataFrame, k: int = 3, source: str = "source", keys: Sequence[str] = ("sample_id",),
             model: str = "aligned", model_idx: int = 0) -> DataFrame:
    """(keys, model_idx, model, candidate_rank, text): the ``k`` best rewrites of every sample.

    ``keys`` is a key of any types, nulls included; samples with words of one key are
    one, their words by place.  A word without options stays; a sample has fewer rewrites when it has
    fewer ways; one without words is rewritten to ''.  A chunk of samples asks once for
    the options of each of its words; samples are written once and shuffled once, whole.
    """
    keys = list(keys)
    base = samples.select(F.struct(*keys).alias("key"), F.array_join(split_ws(empty_if_null(source)), " ").alias("text"))
    base = _in_chunks(base)
    some = base.where("text <> ''")
    twice = stored(some.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"))
    if not twice.isEmpty():
        placed = F.transform(F.split("text", " "), lambda w, i: F.struct(i.alias("pos"), w.alias("s")))
        same = some.join(twice, "key").groupBy("key").agg(F.sort_array(F.flatten(F.collect_list(placed))).alias("words"))
        same = same.select("key", F.array_join("words.s", " ").alias("text"))
        alone = some.join(twice, "key", "left_anti").unionByName(base.where("text = ''"))
        base = _in_chunks(alone.select("key", "text").unionByName(same))
    asked = base.select("chunk", "text").mapInArrow(_asked, "chunk bigint, s string").where("s <> ''")
    told = asked.join(options, "s").select("chunk", "s", F.col("options.cost").alias("costs"), F.col("options.target").alias("targets"))
    both = told.unionByName(base, allowMissingColumns=True).select("chunk", "s", "costs", "targets", "key", "text")

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, costs, targets = None, {}, {}
        for batch in batches:
            rows, ranks, out = [], [], []
            columns = [batch.column(c).to_pylist() for c in ("chunk", "s", "costs", "targets", "text")]
            for at, (chunk, s, cost, target, text) in enumerate(zip(*columns, strict=True)):
                if chunk != now:
                    now, costs, targets = chunk, {}, {}
                if text is None:
                    costs[s], targets[s] = cost, target
                    continue
                words = text.split(" ")
                places = [i for i, w in enumerate(words) if w in costs]
                lists = [costs[words[i]] for i in places]
                plain = [targets[w][0] if w in costs else w for w in words]
                for rank, way in enumerate(cheapest(lists, k)):
                    changed = plain.copy() if way else plain
                    for i, o in way:
                        changed[places[i]] = targets[words[places[i]]][o]
                    rows.append(at)
                    ranks.append(rank)
                    out.append(" ".join(changed))
            yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(rows, pa.int32())), pa.array(ranks, pa.int32()),
                                              pa.array(out, pa.string())], names=["key", "candidate_rank", "text"])
    schema = StructType([both.schema["key"], StructField("candidate_rank", IntegerType()), StructField("text", StringType())])
    found = both.repartition("chunk").sortWithinPartitions("chunk", F.col("text").isNotNull()).mapInArrow(best, schema)
    return found.select(*[F.col("key")[c].alias(c) for c in keys], F.lit(model_idx).alias("model_idx"), F.lit(model).alias("model"),
                        "candidate_rank", "text")
