"""Dumps that arrive as files: a stateless stream of entity lines into the quad table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..sources import dumps


def quads(spark: SparkSession, folder: str, languages: list[str] | None = None, qualifiers: bool = True, files_each: int = 1000) -> DataFrame:
    """A streaming frame of quads from the text files that appear in a folder."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_each).text(folder)
    return dumps.quads(dumps.entities(lines), languages, qualifiers)


def ingest(stream: DataFrame, table: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Appends the stream to a quad table, each file exactly once; once: stop when all present files are in."""
    writer = stream.writeStream.format("parquet").partitionBy("pkey").option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 minute")).start(table)
