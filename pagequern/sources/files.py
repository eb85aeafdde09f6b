"""Pages from files and requests, and records to files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Longer pages aren't taken from requests and fetches.
MOST_BYTES = 5 * 1024 * 1024


def front_matter_url(html: Column) -> Column:
    """The address in a leading comment such as <!-- {"url": "..."} -->, or null."""
    return F.nullif(F.regexp_extract(html, r'(?m)^<!--\s*\{\s*"url"\s*:\s*"([^"]+)"', 1), F.lit(""))


def read_html_files(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, url, html, file) of HTML files, each a page. Without an address in a comment the file's name, after its kind--, is one."""
    files = spark.read.text(path, wholetext=True).select(F.col("value").alias("html"), F.input_file_name().alias("file"))
    stem = F.regexp_replace(F.regexp_extract("file", r"([^/]+)\.html?$", 1), "^[a-z-]+?--", "")
    return files.select(F.xxhash64("file").alias("page_id"), F.coalesce(front_matter_url(F.col("html")), F.concat(F.lit("https://"), stem)).alias("url"), "html", "file")


REQUEST = "html string, url string, options struct<debug:boolean,markdown:boolean,separate_markdown:boolean,remove_exact_selectors:boolean,remove_partial_selectors:boolean>"


def parse_requests(bodies: DataFrame, body: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """The columns to keep and (html, url, options, error) of JSON request bodies: error says why a body isn't taken."""
    parsed = bodies.withColumn("r", F.from_json(body, REQUEST))
    error = (
        F.when(F.col("r").isNull() | F.col("r.html").isNull(), "html is missing or no string")
        .when(F.length("r.html") == 0, "html is empty")
        .when(F.octet_length("r.html") > MOST_BYTES, "html is too large")
    )
    return parsed.select(*keep, "r.html", "r.url", "r.options", error.alias("error"))


def within_cap(pages: DataFrame, html: str = "html", most: int = MOST_BYTES) -> DataFrame:
    return pages.where(F.octet_length(html) <= most)


def write_json(records: DataFrame, path: str) -> None:
    """One JSON object to a line, in the names of the web interface (camel case, null fields left out)."""
    camel = lambda s: "".join(p if i == 0 or not p else p.capitalize() for i, p in enumerate(s.split("_"))) if not s.startswith("_") else s
    records.select(F.to_json(F.struct(*(F.col(c).alias(camel(c)) for c in records.columns))).alias("value")).write.text(path)
