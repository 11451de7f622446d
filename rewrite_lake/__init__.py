"""rewrite_lake: Spark-native analytics for text-rewrite tables.

Public entry points live in the sub-packages:

* ``rewrite_lake.functions`` -- Column expressions (text rules, BLEU, vectors,
  expression scorers).
* ``rewrite_lake.sources``   -- readers, writers and the fixture views.
* ``rewrite_lake.operators`` -- DataFrame -> DataFrame operators (prepare,
  sampling, metrics, candidates, rerank, rewards, run reports, backends).
* ``rewrite_lake.plans``     -- end-to-end jobs and the query registry.
* ``rewrite_lake.streaming`` -- Structured Streaming score-and-rerank.
"""

__version__ = "0.1.0"
