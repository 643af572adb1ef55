"""Micro-batch ingestion and event-time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def stream_files(spark: SparkSession, folder: str, schema, kind: str = "parquet", files_a_batch: int | None = None, bytes_a_batch: int | None = None) -> DataFrame:
    """New files of a folder; a batch ends at a number of files or bytes, besides the trigger's time."""
    reader = spark.readStream.schema(schema).format(kind)
    for name, value in (("maxFilesPerTrigger", files_a_batch), ("maxBytesPerTrigger", bytes_a_batch)):
        reader = reader.option(name, value) if value else reader
    return reader.load(folder)


def checked(stream: DataFrame, schema: str) -> DataFrame:
    """The stream in the table's schema; missing columns or other types are an error."""
    wanted = stream.sparkSession.createDataFrame([], schema).schema
    have = dict(stream.dtypes)
    for f in wanted.fields:
        if have.get(f.name) != f.dataType.simpleString():
            raise ValueError(f"column {f.name}: {f.dataType.simpleString()} is wanted, {have.get(f.name)} given")
    return stream.select(*wanted.names)


def ingest(stream: DataFrame, path: str, checkpoint: str, partition_by: list[str] | None = None, every: str | None = "60 seconds") -> StreamingQuery:
    """Append each micro-batch to a partitioned Parquet table; every=None takes what is there and ends."""
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def tumbling(events: DataFrame, width: str = "1 hour", late: str | None = None) -> DataFrame:
    """Counts and sums per event type and window; with `late`, old state is dropped by watermark."""
    events = events.withWatermark("ts", late) if late else events
    out = events.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out.select(F.col("window.start").alias("window_start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str = "2 hours", every: str = "1 hour", late: str | None = None) -> DataFrame:
    """Counts per event type and overlapping window."""
    events = events.withWatermark("ts", late) if late else events
    out = events.groupBy(F.window("ts", width, every), "event_type").agg(F.count("*").alias("n"))
    return out.select(F.col("window.start").alias("window_start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    out = events.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("session_window.start").alias("session_start"), "n")
