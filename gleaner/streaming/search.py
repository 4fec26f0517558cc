"""Streams of queries against a static index.

Scoring is a join of the stream with the postings followed by a ranking within each micro-batch, so
it runs in ``foreachBatch`` with the same plans as batch search.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from gleaner.plans.search import Searcher


def search_stream(searcher: Searcher, queries: DataFrame, path: str, checkpoint: str, k: int, **options) -> StreamingQuery:
    """Append the results of each micro-batch of queries(qid, text) to ``path``.

    A batch that is replayed after a failure overwrites its own folder, so results come once.
    """

    def answer(batch: DataFrame, number: int) -> None:
        searcher.search(batch, k, **options).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return queries.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint).start()
