"""Searching a stream of queries: each micro-batch runs as one batch against a static index. An extension of the batch API."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from titleforge.functions.scoring import Scorer
from titleforge.operators.index import NameIndex
from titleforge.operators.search import search_names


def search_stream(queries: DataFrame, index: NameIndex, sink: str, checkpoint: str, scorer: Scorer = Scorer.OKAPI_BM25, size: int = 30, stop_ratio: float = 0.01) -> StreamingQuery:
    """Write (qid, id, score, rank, batch) of a stream (qid, name) as Parquet below ``sink``; a batch that is run again replaces its own folder."""

    def run(batch: DataFrame, number: int) -> None:
        search_names(batch, index, scorer, size, stop_ratio).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return queries.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
