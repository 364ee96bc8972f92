"""Whole events from a stream: each micro-batch is scored as a table and appended to a sink."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from cloudloom.operators.metrics import purity_completeness
from cloudloom.plans.chain import cluster
from cloudloom.plans.config import ChainConfig


def cluster_stream(hits: DataFrame, keys: list[str], path: str, checkpoint: str, config: ChainConfig | None = None) -> StreamingQuery:
    """Cluster events as they arrive (a file holds whole events); a batch that is retried replaces its own output."""

    def each(batch: DataFrame, number: int) -> None:
        cluster(batch, keys, config).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return hits.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def score_stream(hits: DataFrame, keys: list[str], path: str, checkpoint: str) -> StreamingQuery:
    """Purity and completeness of labelled events as they arrive."""

    def each(batch: DataFrame, number: int) -> None:
        purity_completeness(batch, keys).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return hits.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
