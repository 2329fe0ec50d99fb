"""User code per decoded message, in batch and in streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

# (messages with their connection_id, index of the worker) -> result rows
Handler = Callable[[pd.DataFrame, int], pd.DataFrame]


def handle(messages: DataFrame, handler: Handler, schema: str) -> DataFrame:
    """Run ``handler`` over batches of messages, on the workers; the worker index is the partition's number.

    How the messages are cut into batches is up to Spark, so a handler may not rely on it.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        worker = TaskContext.get().partitionId()
        for batch in batches:
            yield handler(batch, worker)

    return messages.mapInPandas(run, schema)


def handle_stream(
    stream: DataFrame, handler: Callable[[DataFrame, int], None], checkpoint: str, **trigger
) -> StreamingQuery:
    """Call ``handler(messages, batch_id)`` once per micro-batch. A failed batch comes again with the same id."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(handler)
    return (writer.trigger(**trigger) if trigger else writer).start()
