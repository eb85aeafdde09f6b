"""Extraction over tables of pages. Every operator here is a map without any shuffle."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from pagequern.extract import page
from pagequern.extract.markdown import html_to_markdown
from pagequern.extract.options import Options
from pagequern.extract.sites import bbcode_to_html
from pagequern.extract.text import html_to_text
from pagequern.html.dom import parse

_KINDS = {"string": T.StringType(), "bigint": T.LongType(), "int": T.IntegerType()}


def _struct(fields: str, **nested: T.DataType) -> T.StructType:
    """A struct of "name kind" pairs; kinds are simple ones or keys of nested. Built without a session, as workers import this."""
    return T.StructType([T.StructField(name, (_KINDS | nested)[kind]) for name, kind in (f.split() for f in fields.split(", "))])


_ACTION = _struct("type string, url string, name string, splashImageUrl string, splashBackgroundColor string")
_EMBED = _struct("version string, imageUrl string, button button", button=_struct("title string, action action", action=_ACTION))
RECORD = _struct(
    "content string, content_markdown string, extractor_type string, meta_tags meta, title string, description string, domain string, favicon string, image string, "
    "published string, author string, site string, schema_org_data strings, word_count bigint, parse_time bigint, mini_app_embed embed, _error string",
    meta=T.ArrayType(_struct("name string, property string, content string")), strings=T.ArrayType(T.StringType()), embed=_EMBED,
)
#: Bytes that a row group of a file has at least, unless the file is small.
ROW_GROUP = 1 << 26
MESSAGES = T.ArrayType(_struct("author string, timestamp string, html string, depth int"))


@lru_cache(16)
def record_udf(options: Options = Options()):
    """(html, url) to a struct of RECORD. One evaluation serves all fields that are taken from it."""
    kind = to_arrow_type(RECORD)

    @F.arrow_udf(RECORD)
    def extract_page(html: pa.Array, url: pa.Array) -> pa.Array:
        return pa.array([_record(h, u, options) for h, u in zip(html.to_pylist(), url.to_pylist(), strict=True)], kind)

    return extract_page


def _record(html: str | None, url: str | None, options: Options) -> dict:
    try:
        return page.extract(html, url, options)
    except Exception as e:  # a page that can't be read must not fail its task
        return {"_error": f"{type(e).__name__}: {e}"}


@lru_cache(16)
def request_udf(defaults: Options = Options()):
    """(html, url, options) to a struct of RECORD; of a row's options, those that aren't null replace the defaults. A null html gives no record."""
    kind = to_arrow_type(RECORD)

    def one(html: str | None, url: str | None, own: dict | None) -> dict | None:
        given = {k: v for k, v in (own or {}).items() if v is not None}
        return None if html is None else _record(html, url, replace(defaults, **given))

    @F.arrow_udf(RECORD)
    def extract_request(html: pa.Array, url: pa.Array, options: pa.Array) -> pa.Array:
        return pa.array([one(*row) for row in zip(html.to_pylist(), url.to_pylist(), options.to_pylist(), strict=True)], kind)

    return extract_request


@F.arrow_udf(MESSAGES)
def messages_of(html: pa.Array, url: pa.Array) -> pa.Array:
    """(html, url) to the messages of a thread or chat."""
    rows = ([vars(m) for m in page.messages(h, u)] for h, u in zip(html.to_pylist(), url.to_pylist(), strict=True))
    return pa.array(list(rows), to_arrow_type(MESSAGES))


def _text_udf(of):
    @F.arrow_udf(T.StringType())
    def convert(html: pa.Array) -> pa.Array:
        return pa.array([None if h is None else of(h) for h in html.to_pylist()], pa.string())

    return convert


to_markdown = _text_udf(html_to_markdown)
to_text = _text_udf(html_to_text)
from_bbcode = _text_udf(bbcode_to_html)


@F.arrow_udf(T.StringType())
def to_titled_markdown(html: pa.Array, title: pa.Array, base: pa.Array) -> pa.Array:
    """(html, title, base) to Markdown without the heading that repeats the title, and with links made absolute."""
    rows = zip(html.to_pylist(), title.to_pylist(), base.to_pylist(), strict=True)
    return pa.array([None if h is None else html_to_markdown(h, t or "", b) for h, t, b in rows], pa.string())


def spread(rows: DataFrame) -> DataFrame:
    """rows, dealt out anew if a small table may leave cores idle: a page costs milliseconds, moving it does not.

    Files are cut by bytes but read by row groups, so splits that are smaller than a group are empty but for one.
    """
    cores, n = rows.sparkSession.sparkContext.defaultParallelism, rows.rdd.getNumPartitions()
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    thin = size < n * ROW_GROUP and len(rows.inputFiles()) < cores
    return rows.repartition(cores) if n < cores or thin else rows


def extract(pages: DataFrame, options: Options = Options(), html: str = "html", url: str = "url", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """A record for each page: the columns to keep, the url, and the fields of RECORD.

    Filters on the columns to keep and on url reach the scan; to filter on a field, write the result
    first or the pages are parsed twice.
    """
    return pages.select(*keep, url, record_udf(options)(F.col(html), F.col(url)).alias("r")).select(*keep, url, "r.*")


def extract_requests(requests: DataFrame, defaults: Options = Options(), keep: tuple[str, ...] = ()) -> DataFrame:
    """A record for each request of parse_requests(), by its own options; the fields are null where error says why it isn't taken."""
    taken = F.when(F.col("error").isNull(), F.col("html"))
    return requests.select(*keep, "url", "error", request_udf(defaults)(taken, F.col("url"), F.col("options")).alias("r")).select(*keep, "url", "error", "r.*")


def messages(pages: DataFrame, html: str = "html", url: str = "url", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """A row for each message of threads and chats: the columns to keep, pos, author, timestamp, html, depth."""
    return pages.select(*keep, F.posexplode(messages_of(F.col(html), F.col(url))).alias("pos", "m")).select(*keep, "pos", "m.*")


_NODES = _struct(
    "pre bigint, post bigint, parent bigint, depth int, pos int, tag string, attrs attrs, text string, text_bytes bigint, link_bytes bigint",
    attrs=T.MapType(T.StringType(), T.StringType()),
)


def nodes(pages: DataFrame, html: str = "html", keep: str = "page_id") -> DataFrame:
    """The tree of each page as rows, for SQL over structure.

    pre and post number elements as they begin and end, so that a contains b if a.pre < b.pre and
    a.post > b.post; text is an element's own text, text_bytes and link_bytes are of all below.
    """
    key_field = pages.schema[keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in _NODES])
        for batch in batches:
            for key, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows: list[dict] = []
                posts = iter(range(1 << 62))

                def visit(n, parent, depth, pos, linked):
                    row = {"pre": len(rows), "parent": parent, "depth": depth, "pos": pos, "tag": n.tag, "attrs": list(n.attrs.items())}
                    rows.append(row)
                    own, total, links, at = [], 0, 0, 0
                    for c in n.children:
                        if c.tag == "#text":
                            own.append(c.data)
                            size = len(c.data.encode())
                            total, links = total + size, links + (size if linked or n.tag == "a" else 0)
                        elif c.element:
                            t, k = visit(c, row["pre"], depth + 1, at, linked or n.tag == "a")
                            total, links, at = total + t, links + k, at + 1
                    row |= {"text": "".join(own), "text_bytes": total, "link_bytes": links, "post": next(posts)}
                    return total, links

                for c in parse(source or "").children:
                    if c.element:
                        visit(c, None, 0, 0, False)
                table = pa.Table.from_pylist(rows, schema)
                keys = pa.array([key] * len(rows), batch.schema.field(0).type)
                for b in table.add_column(0, keep, keys).to_batches():
                    yield b

    return pages.select(keep, html).mapInArrow(run, T.StructType([key_field, *_NODES]))


def rendered_conversation(author: Column, timestamp: Column, html: Column, depth: Column) -> Column:
    """The HTML of one message, in SQL alone."""
    escaped = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    by = F.when(author.isNotNull(), F.concat(F.lit('<p class="conversation-author"><strong>'), escaped(author), F.lit("</strong></p>"))).otherwise("")
    at = F.when(timestamp.isNotNull(), F.concat(F.lit('<p class="conversation-timestamp"><em>'), escaped(timestamp), F.lit("</em></p>"))).otherwise("")
    return F.concat(F.repeat(F.lit("<blockquote>"), depth), F.lit('<div class="conversation-message">'), by, at, html, F.lit("</div>"), F.repeat(F.lit("</blockquote>"), depth))


def register_functions(spark: SparkSession, options: Options = Options()) -> None:
    """Makes the converters SQL functions: extract_page, html_to_markdown, html_to_text, bbcode_to_html, conversation_messages."""
    for name, f in (("extract_page", record_udf(options)), ("html_to_markdown", to_markdown), ("html_to_text", to_text), ("bbcode_to_html", from_bbcode), ("conversation_messages", messages_of)):
        spark.udf.register(name, f)

