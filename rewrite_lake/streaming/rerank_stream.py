"""Streaming score-and-rerank (STR-01, SNK-05).

Re-aims the reference's row-at-a-time writer (flushes results every 10 rows)
and its interactive loop as a Structured Streaming query:

    readStream(files of samples) --foreachBatch--> batch rerank --> parquet

All candidates of a sample are generated from that sample's row, so a
sample's top-1 never needs rows from another micro-batch: no watermark and
no state store.  ``foreachBatch`` reuses the batch operators unchanged, so
stream == batch by construction.  Each micro-batch writes to its own
``batch_id=`` folder with overwrite, so a replay after a failure rewrites the
same folder (idempotent); progress lives in the checkpoint location.
"""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators import rerank as RR
from ..operators.candidates import DEFAULT_MODELS

SAMPLE_SCHEMA = "sample_id bigint, source string, reference string"


def rerank_stream(spark: SparkSession, input_dir: str, output_dir: str, checkpoint: str,
                  models: Sequence[str] = DEFAULT_MODELS, weights=None, threshold: float = 0.5,
                  fmt: str = "parquet", trigger: dict | None = None,
                  max_files_per_trigger: int | None = None) -> StreamingQuery:
    """Start the streaming rerank; returns the running query."""
    reader = spark.readStream.schema(SAMPLE_SCHEMA).format(fmt)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    if fmt == "csv":
        reader = reader.options(sep="\t", header="true", quote='"', escape='"')
    stream = reader.load(input_dir)

    def process(batch: DataFrame, batch_id: int) -> None:
        _, best = RR.rerank(batch, models=models, weights=weights, threshold=threshold)
        RR.selected_rows(best).write.mode("overwrite").parquet(os.path.join(output_dir, f"batch_id={batch_id}"))

    writer = stream.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint)
    writer = writer.trigger(**(trigger or {"availableNow": True}))
    return writer.start()
