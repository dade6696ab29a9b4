"""Requests as a stream: an extension, for the place that a socket server would have.

Each micro-batch of requests is answered by the same batch query as a request
table; its answers are written under the batch's number, so that a batch that
runs again replaces its own answers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.grid import circle_join


def answer_stream(requests: DataFrame, answer: Callable[[DataFrame], DataFrame], folder: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Answer a streaming request table (say ``lambda r: trace.three_point(samples, r)``) below ``folder``; ``once``: what is there now, then stop."""

    def batch(rows: DataFrame, number: int) -> None:
        answer(rows).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    writer = requests.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def stream_circles(requests: DataFrame, samples: DataFrame, metric: str = "planar") -> DataFrame:
    """Samples inside the circles of a stream of requests: a stream-static join by cell, without state."""
    return circle_join(samples, requests, metric)
