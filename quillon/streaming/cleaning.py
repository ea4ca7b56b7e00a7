"""The cleaning plan on a stream of documents.

Each rule reads one document, so all hold unchanged for a stream in append mode.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..plans.cleaning import clean
from ..plans.config import Settings, preset

STREAM_SETTINGS = preset("training")


def documents_stream(spark: SparkSession, folder: str, schema: str = "doc_id long, text string") -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def clean_stream(docs: DataFrame, settings: Settings = STREAM_SETTINGS) -> DataFrame:
    return clean(docs, settings)


def write_stream(cleaned: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Writes what has arrived, exactly once, and ends."""
    return cleaned.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
