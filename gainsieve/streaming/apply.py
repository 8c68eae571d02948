"""Fitted models on streams: matching and scoring are row-local, so they need no state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gainsieve.plans.miner import PatternModel


def match_stream(stream: DataFrame, model: PatternModel) -> DataFrame:
    """Add ``item_ids`` and ``pids`` to a streaming frame, one row for each row, for any number of patterns.

    Category ids and, beyond the inline limit, patterns come from stream-static left joins.
    """
    return model.match(stream)


def count_patterns(stream: DataFrame, model: PatternModel) -> DataFrame:
    """(pid, n): running number of rows per pattern, for complete or update output."""
    matched = match_stream(stream, model).select(F.explode("pids").alias("pid"))
    return matched.groupBy("pid").agg(F.count("*").alias("n"))


def write_matches(stream: DataFrame, model: PatternModel, keys: list[str], path: str, checkpoint: str) -> StreamingQuery:
    """Write (keys, pids) of all available rows to parquet, exactly once, and stop."""
    matched = match_stream(stream, model).select(*keys, "pids")
    return (
        matched.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
