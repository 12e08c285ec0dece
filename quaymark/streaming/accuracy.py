"""Accuracy per format over a stream of log rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaymark.operators.scoring import scored


def stream_accuracy(log: DataFrame, lateness: str = "9 days", by: str = "node_id") -> DataFrame:
    """Right, wrong and total per format so far, in update mode; a row delivered again is counted once.

    Rows are told apart by ``log_id`` within the watermark on ``arrived_at``; the counts are mergeable, so a
    stream and one pass over the same rows agree.
    """
    once = log.withWatermark("arrived_at", lateness).dropDuplicatesWithinWatermark(["log_id"])
    hits = scored(once)
    return hits.groupBy(by).agg(F.sum(F.col("is_right").cast("bigint")).alias("right_count"), F.sum(F.col("is_wrong").cast("bigint")).alias("wrong_count"), F.count("*").alias("total"))
