"""Candidates that arrive late: one best candidate per sample from a stream (STR-01, SET-02).

Backends answer at their own pace, so the candidates of one sample lie in several
micro-batches.  Each candidate is scored where it arrives (no state); keyed state then
holds, per sample, the best one so far and the numbers of the candidates seen:

* *complete*: once ``n_expected`` different candidates were seen, the best is emitted;
* *timed out*: once the watermark is ``patience`` past the sample's latest candidate,
  the best of those seen is emitted with ``complete`` false.

The order is that of :func:`rerank.top1`, a minimum, so the way the candidates are
dealt over batches can't show in a complete sample.  A candidate is known by
``(model_idx, candidate_rank)``: one that is delivered again changes nothing.  State is
one row per open sample (its best text and at most ``n_expected`` numbers); an emitted
sample leaves a row without a text that goes at its time-out, by when the watermark
turns away repeats of what was seen.

Spark hands every group to Python column by column, which costs more than the work on
its few rows: a candidate travels as one JSON text, and so does what is emitted but the
key and the text.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import intervals
from ..operators import rerank as RR

_BEST = "bad int, neg double, model_idx int, candidate_rank int, model string, text string, objective double"
_STATE = _BEST + ", seen array<bigint>, expected bigint, latest bigint, done boolean"
_PACKED, _SENT = "__packed", "__sent"
_EMITTED = ("model_idx int, model string, candidate_rank int, text string, objective double, "
            "n_seen int, n_expected bigint, complete boolean")


def _plain(v):
    return None if v is None or v is pd.NaT or (isinstance(v, float) and v != v) else v


def _chooser(names: Sequence[str], patience_ms: int):
    """The state function for samples with key columns ``names``."""
    columns = [*names, "text", _SENT]

    def row(key, best, seen, expected, complete) -> pd.DataFrame:
        _, _, model_idx, rank, model, text, objective = best
        sent = json.dumps({"model_idx": model_idx, "model": model, "candidate_rank": rank, "objective": objective,
                           "n_seen": len(seen), "n_expected": expected, "complete": complete})
        return pd.DataFrame([[*map(_plain, key), text, sent]], columns=columns, dtype=object)

    def choose(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            *best, seen, expected, _, done = state.get
            state.remove()
            if not done:
                yield row(key, best, seen, expected, False)
            return
        best, seen, expected, latest, done = None, set(), None, None, False
        if state.exists:
            *best, numbers, expected, latest, done = state.get
            seen = set(numbers)
        for frame in frames:
            for packed in frame[_PACKED].tolist():
                one = json.loads(packed)
                latest = one["moment"] if latest is None else max(latest, one["moment"])
                if done:
                    continue
                bad, neg, wanted = one["bad"], float(one["neg"]), one["n_expected"]
                one = [bad, neg, one["model_idx"], one["candidate_rank"], one["model"], one["text"], None if bad else -neg]
                seen.add((one[2] << 32) | one[3])
                best = one if best is None or one[:4] < list(best[:4]) else best
                if wanted is not None:
                    expected = max(expected or 0, wanted)
        if not done and expected is not None and len(seen) >= expected:
            yield row(key, best, seen, expected, True)
            best, seen, done = [*best[:4], None, None, None], set(), True
        state.update((*best, sorted(seen), expected, latest, done))
        state.setTimeoutTimestamp(max(latest + patience_ms, state.getCurrentWatermarkMs()) + 1)

    return choose


def best_of_stream(candidates: DataFrame, key: str | Sequence[str] = "sample_id", weights=None, threshold: float = 0.5,
                   patience: str = "10 minutes", lateness: str = "0 seconds") -> DataFrame:
    """Stream of candidates -> stream of one row per sample, in append mode.

    ``candidates``: the key columns, ``source`` and ``reference`` of the sample,
    ``model_idx``, ``model``, ``candidate_rank``, ``text``, ``n_expected`` (candidates
    that the sample will have; NULL: not known, the sample waits for its time-out) and
    ``event_time``.  Rows older than the watermark (the latest time less ``lateness``)
    are dropped, as always in a stream.  A candidate without a time, number or rank can
    be neither ordered nor told apart and takes no part; one without a text is scored
    as NULL and only wins alone.
    """
    keys = [key] if isinstance(key, str) else list(key)
    known = candidates.where("event_time is not null and model_idx is not null and candidate_rank is not null")
    rows = known.withWatermark("event_time", lateness).select(
        *keys, "source", "reference", "model_idx", "model", "candidate_rank", "text", "n_expected", "event_time")
    scored = RR.score_candidates(RR.prepare_samples(rows), weights=weights, threshold=threshold)
    obj = F.col("objective")
    bad = obj.isNull() | F.isnan(obj)
    packed = F.struct(bad.cast("int").alias("bad"), F.when(bad, F.lit(0.0)).otherwise(-obj).alias("neg"),
                      F.col("model_idx").cast("int").alias("model_idx"), F.col("candidate_rank").cast("int").alias("candidate_rank"),
                      "model", "text", F.col("n_expected").cast("bigint").alias("n_expected"), F.unix_millis("event_time").alias("moment"))
    slim = scored.select(*keys, F.to_json(packed, {"ignoreNullFields": "false"}).alias(_PACKED), "event_time")
    out = T.StructType([slim.schema[k] for k in keys]).add("text", "string").add(_SENT, "string")
    best = slim.groupBy(*keys).applyInPandasWithState(
        _chooser(keys, intervals.milliseconds(patience)), out, T.StructType.fromDDL(_STATE), "append",
        GroupStateTimeout.EventTimeTimeout)
    emitted = T.StructType.fromDDL(_EMITTED)
    sent = F.from_json(_SENT, emitted)
    return best.select(*keys, *[F.col(c) if c == "text" else sent[c].alias(c) for c in emitted.names])


def start(candidates: DataFrame, output_dir: str, checkpoint: str, trigger: dict | None = None, **options) -> StreamingQuery:
    """:func:`best_of_stream` into a Parquet folder; returns the running query.  The
    sink's log makes a repeated batch write nothing twice; read the folder with Spark."""
    writer = best_of_stream(candidates, **options).writeStream.format("parquet").outputMode("append")
    writer = writer.option("checkpointLocation", checkpoint).option("path", output_dir)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
