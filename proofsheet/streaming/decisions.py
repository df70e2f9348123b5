"""The decision log as a stream. An extension: the engine itself is batch only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofsheet.sources.cases import REVIEW_EVENTS


def decision_stream(spark: SparkSession, path: str, files: int = 100) -> DataFrame:
    return spark.readStream.schema(REVIEW_EVENTS).option("maxFilesPerTrigger", files).parquet(path)


def current_decisions(log: DataFrame) -> DataFrame:
    """The last decision per case, packet, criterion and document, for update or complete mode; state is one row a key."""
    return log.groupBy("case_id", "packet", "stt", "document").agg(F.max_by(F.struct("to_status", "reason"), "seq").alias("last"), F.max("seq").alias("seq")).select("case_id", "packet", "stt", "document", "last.*", "seq")
