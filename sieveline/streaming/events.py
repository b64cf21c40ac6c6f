"""Events as a stream: the same reply as in batch, row by row, without state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from sieveline.functions.rules import Rule
from sieveline.operators.events import reply_column
from sieveline.operators.redact import redact_text


def event_stream(spark: SparkSession, folder: str) -> DataFrame:
    """One row an event: the lines of the files that arrive in a folder. A file is read once, so it must be moved there complete."""
    return spark.readStream.format("text").option("lineSep", "\n").load(folder).withColumnRenamed("value", "event")


def replies(events: DataFrame, rules: list[Rule] | None = None, root: str | None = None) -> DataFrame:
    return events.withColumn("r", reply_column(events["event"], rules, root)).select("event", "r.reply", "r.error")


def redacted_stream(texts: DataFrame, rules: list[Rule], keys: bool = True) -> DataFrame:
    return redact_text(texts, rules, keys)


def run(stream: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Starts the stream into a sink for each batch; with the same checkpoint it goes on where it stopped."""
    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(sink).start()
