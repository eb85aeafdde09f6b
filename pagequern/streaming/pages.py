"""Extraction of pages as they arrive: the batch operators over a stream, without state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pagequern.extract.options import Options
from pagequern.operators.pages import extract


def read_pages(spark: SparkSession, path: str, schema: str = "page_id bigint, url string, html string", max_files: int | None = 64) -> DataFrame:
    """New parquet files of a folder, or of a file pattern, as a stream of pages. max_files: of one trigger; None for all there are."""
    reader = spark.readStream.schema(schema)
    return (reader if max_files is None else reader.option("maxFilesPerTrigger", max_files)).parquet(path)


def extracted(stream: DataFrame, options: Options = Options()) -> DataFrame:
    return extract(stream, options)


def write_parquet(stream: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Appends the stream to a parquet folder, exactly once: the file sink's log and the checkpoint recover a lost run."""
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def counts_by_window(events: DataFrame, time: str = "ts", key: str = "event_type", window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events by key and window; a window is final when the watermark, the latest time less late, has passed it."""
    return events.withWatermark(time, late).groupBy(F.window(time, window), key).agg(F.count("*").alias("n_events"))


def run_to_table(stream: DataFrame, folder: str, transform: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Runs a transformed stream over all that is there now and returns what it wrote. folder: shared by driver and executors."""
    query = write_parquet(transform(stream), f"{folder}/out", f"{folder}/log")
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    return stream.sparkSession.read.parquet(f"{folder}/out")
