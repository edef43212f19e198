"""Votes for queries that arrive as a stream, against training rows at rest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from rarefold.operators import votes
from rarefold.operators.neighbours import class_lists, sizes


def scored_stream(queries: DataFrame, train: DataFrame, path: str, checkpoint: str, *, alpha: float = 1.0, soft: bool = False, once: bool = False) -> StreamingQuery:
    """Appends id, y, frac and y_pred of every batch of queries (id, y, v) to path, in a folder by batch: a batch that is repeated after a failure replaces its own."""
    s = sizes(train)

    def batch(rows: DataFrame, number: int) -> None:
        lists = class_lists(rows, train, s.k_min_eff, s.k_maj)
        votes.single(lists, s, alpha, soft).write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = queries.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
