"""Stateless scoring of a stream of prediction pairs, and append with resume per micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.score import score_rows
from ..sources.append_log import AppendLog


def scored_stream(pairs: DataFrame) -> DataFrame:
    """Scored rows of a streaming (or static) table with response_vi and model_output: no state, so no watermark."""
    return score_rows(pairs)


def append_stream(rows: DataFrame, path: str, checkpoint: str, key: str = "source_hash", name: str = "stream") -> StreamingQuery:
    """Writes the rows of a stream whose key the output lacks, each micro-batch exactly once; rows without a key are all kept. `name` tells the streams of one output apart."""

    def put(batch: DataFrame, number: int) -> None:
        AppendLog(batch.sparkSession, path, key).append(batch, f"{name}-{number}")

    return rows.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
