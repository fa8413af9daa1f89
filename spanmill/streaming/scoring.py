"""Scoring feature files as they arrive: a stateless stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.labels import KEY
from ..operators.pileup import SCHEMA
from ..plans.model import Bundle


def feature_stream(spark: SparkSession, folder: str, schema: str = SCHEMA) -> DataFrame:
    return spark.readStream.schema(schema).option("header", True).csv(folder)


def score_stream(features: DataFrame, bundle: Bundle, out: str, checkpoint: str, *, once: bool = False) -> StreamingQuery:
    """Key, prob and passed of each feature row, appended as Parquet."""
    scored = bundle.score(features)
    writer = scored.select(*KEY, "prob", (scored["prob"] >= bundle.threshold).alias("passed")).writeStream.format("parquet").option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start(out)
