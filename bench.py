"""Benchmark the headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``.

Each query is executed in full with the ``noop`` sink (every row computed, no
driver collect), after one warm-up run of a small query to start the JVM.
Prints ONE JSON line: {"metric", "value" (total seconds), "unit", "queries",
"rows", "rows_per_sec", "sf"}.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "rerank_selected",        # RPT-05: candidates -> scores -> top-1 (the flagship job)
    "rerank_metrics",         # corpus metrics of the selection
    "metric_bundle_by_lang",  # RPT-07: evaluator over every document line, per language
    "corpus_bleu",            # BLEU-05 over prepared pairs
    "bleu_tokens",            # 13a tokenization of whole documents
    "prepare_pairs",          # RSH-01
    "split_exact",            # SMP-04 exact global ranks
    "reward_batch_stats",     # AGG-08 / WIN-02 over scored document lines
    "eval_summary",           # AGG-07 per model
    "run_summary",            # RPT-01 roll-up
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from rewrite_lake.session import get_session
    spark = get_session(master=f"local[{cpus}]", extra={"spark.rewriteLake.scanPartitions": cpus})
    from rewrite_lake.plans.catalog import QUERIES

    QUERIES["prepare_audit"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up
    times, rows = {}, {}
    for name in HEADLINE:
        t0 = time.time()  # building counts: a query's jobs are its own
        df = QUERIES[name](spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
        rows[name] = None
    # row counts (not timed): what each query produced
    for name in HEADLINE:
        rows[name] = QUERIES[name](spark, sf_dir).count()
    total = round(sum(times.values()), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({
        "metric": "headline_total_sec", "value": total, "unit": "sec", "queries": times,
        "rows": rows, "rows_per_sec": {k: round(rows[k] / times[k], 1) if times[k] else None for k in HEADLINE},
        "sf": float(sf) if sf.replace(".", "").isdigit() else sf}))
    spark.stop()


if __name__ == "__main__":
    main()
