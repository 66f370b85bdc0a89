"""Texts that arrive in a folder, redacted as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from spanveil.config import EngineConfig
from spanveil.plans.pipeline import detect, redact


def texts(spark: SparkSession, path: str) -> DataFrame:
    """A stream of whole files: path, text."""
    raw = spark.readStream.format("text").option("wholetext", True).load(path)
    return raw.select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", "^\ufeff", "").alias("text"))


def start(spark: SparkSession, source: str, sink: str, checkpoint: str, config: EngineConfig = EngineConfig()) -> StreamingQuery:
    """Redacts what is new since the last run; the checkpoint is the ledger, so a restart repeats nothing."""
    found = detect(texts(spark, source), "text", config=config)
    out = found.select("path", F.size("spans").alias("n_spans"), redact(F.col("text"), F.col("spans")).alias("redacted"))
    return out.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
