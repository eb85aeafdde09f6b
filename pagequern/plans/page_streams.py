"""Queries that run the streaming path over a whole table and return what the sink holds."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagequern.functions import html as H
from pagequern.streaming import pages as S


def shared_folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir. Where that is unset, a temporary one on a local master, as in tests, and an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is unset: it has to name a folder that the driver and all executors share")
    base = base or tempfile.mkdtemp(prefix="pagequern-stream-")
    return f"{base}/stream-{uuid.uuid4().hex}"


def stream_page_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    def summary(stream: DataFrame) -> DataFrame:
        html = F.coalesce("html", F.lit(""))
        return stream.select("page_id", H.title_of(html).alias("title"), H.count_words(html).alias("word_count"))

    # a table is one file or a folder of files: the pattern fits both
    return S.run_to_table(S.read_pages(spark, f"{sf_dir}/pages.parquet*"), shared_folder(spark), summary)


def stream_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages through the extraction, as a stream."""
    found = S.run_to_table(S.read_pages(spark, f"{sf_dir}/pages.parquet*"), shared_folder(spark), S.extracted)
    return found.select("page_id", "title", "domain", "word_count")


def stream_event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by type and hour, as far as the watermark has closed the hours."""
    # one trigger: files of a stored table aren't in the order of their times, and a later trigger drops what is behind the watermark
    events = S.read_pages(spark, f"{sf_dir}/events.parquet*", "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string", None)
    found = S.run_to_table(events, shared_folder(spark), S.counts_by_window)
    return found.select(F.date_format("window.start", "yyyy-MM-dd HH:mm").alias("hour"), "event_type", "n_events")


QUERIES = {f.__name__: f for f in (stream_page_summary, stream_extract, stream_event_counts)}
ORACLE_SQL = {
    "stream_page_summary": r"""
SELECT page_id, trim(regexp_extract(coalesce(html, ''), '<title[^>]*>(.*?)</title>', 1)) AS title,
  len(regexp_extract_all(regexp_replace(coalesce(html, ''), '<[^>]+>', ' ', 'g'), '[^\x20\x09-\x0D]+'))::BIGINT AS word_count FROM pages""",
    "stream_event_counts": """
SELECT strftime(h, '%Y-%m-%d %H:%M') AS hour, event_type, count(*) AS n_events FROM (SELECT date_trunc('hour', ts) AS h, event_type FROM events)
WHERE h + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 2 HOUR GROUP BY ALL""",
}
