"""Page queries that are built-in SQL expressions throughout, with the same in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagequern.extract.cleanup import NAVIGATION
from pagequern.functions import html as H
from pagequern.functions import urls as U
from pagequern.sources import read_table


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "pages")


def html() -> Column:
    return F.coalesce(F.col("html"), F.lit(""))


def page_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title, domain, words and links of each page."""
    return pages(spark, sf_dir).select("page_id", H.title_of(html()).alias("title"), U.domain_of(F.col("url")).alias("domain"), H.count_words(html()).alias("word_count"), H.count_links(html()).alias("n_links"))


def page_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = H.body_of(html())
    return pages(spark, sf_dir).select("page_id", F.length(body).cast("long").alias("body_chars"), F.md5(body).alias("body_md5"))


def strip_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).select("page_id", F.md5(H.strip_tags(html())).alias("text_md5"))


def strip_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).select("page_id", F.md5(H.without_comments(html())).alias("html_md5"))


def text_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).select("page_id", H.score_text(html()).alias("score"))


def _tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, pos, tag, class, id) of each start tag."""
    each = pages(spark, sf_dir).select("page_id", F.posexplode(H.tokens(html())).alias("pos", "token")).where(F.col("token").rlike("^<[a-zA-Z]"))
    part = lambda p: F.regexp_extract("token", p, 1)
    return each.select("page_id", "pos", F.lower(part("^<([a-zA-Z][a-zA-Z0-9]*)")).alias("tag"), part(' class="([^"]*)"').alias("class"), part(' id="([^"]*)"').alias("id"))


def attribute_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = _tags(spark, sf_dir).where(F.col("tag").isin("div", "section", "article", "main", "nav", "aside", "footer", "header"))
    score = H.score_attributes(F.col("tag"), F.nullif(F.col("class"), F.lit("")), F.nullif(F.col("id"), F.lit("")))
    return scored.select("page_id", F.col("pos").cast("long").alias("pos"), "tag", score.alias("score"))


def tag_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tags(spark, sf_dir).groupBy("tag").agg(F.count("*").alias("n_tags"), F.countDistinct("page_id").alias("n_pages"))


def clutter_name_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often classes and ids name menus and the like."""
    hits = _tags(spark, sf_dir).withColumn("hits", H.navigation_hits(F.concat_ws(" ", "tag", "class", "id")).cast("long"))
    return hits.groupBy("page_id").agg(F.sum("hits").alias("n_hits"))


def pages_by_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).groupBy(U.host_of(F.col("url")).alias("host")).agg(F.count("*").alias("n_pages"), F.sum(H.count_words(html())).alias("words"))


def top_pages_by_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three pages of each domain with the most links."""
    found = pages(spark, sf_dir).select("page_id", U.domain_of(F.col("url")).alias("domain"), H.count_links(html()).alias("n_links"))
    rank = F.row_number().over(Window.partitionBy("domain").orderBy(F.desc("n_links"), "page_id")).cast("long")
    return found.withColumn("rank", rank).where("rank <= 3")


def lang_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages and words by language and scheme with subtotals."""
    found = pages(spark, sf_dir).select(F.regexp_extract(html(), '<html lang="([a-z]+)"', 1).alias("lang"), F.regexp_extract("url", "^([a-z]+):", 1).alias("scheme"), H.count_words(html()).alias("words"))
    return found.rollup("lang", "scheme").agg(F.count("*").alias("n_pages"), F.sum("words").alias("words"))


def oversize_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages up to the size that the HTTP interface takes."""
    return pages(spark, sf_dir).where(F.octet_length(html()) <= 5 * 1024 * 1024).select("page_id", F.octet_length(html()).cast("long").alias("n_bytes"))


def _probe_url(key: Column) -> Column:
    """Addresses of all kinds, made of a key."""
    kinds = (
        "http://10.0.0.{}/a", "https://example.com/{}", "ftp://example.com/{}", "http://192.168.1.{}/", "http://localhost:{}/x", "https://printer.local/{}", "http://172.20.1.{}/",
        "http://8.8.8.8/{}", "https://[::1]/{}", "https://[fd00::1]/{}", "http://100.64.0.1/{}", "not a url {}", "https://user@127.0.0.1/{}", "https://a.internal/{}", "http://169.254.1.1/{}", "https://[2001:db8::1]/{}",
    )
    return F.replace(F.element_at(F.array(*map(F.lit, kinds)), (F.pmod(key, F.lit(len(kinds))) + 1).cast("int")), F.lit("{}"), (key % 200).cast("string"))


def ssrf_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    probed = read_table(spark, sf_dir, "orders").select("o_orderkey", _probe_url(F.col("o_orderkey")).alias("url"))
    return probed.select("o_orderkey", U.may_be_fetched(F.col("url")).alias("allowed"))


SITE_URLS = (
    ("x-article", "https://x.com/a_b/article/{}"), ("twitter", "https://twitter.com/jane/status/{}"), ("reddit", "https://old.reddit.com/r/test/comments/a{}/t/"), ("hackernews", "https://news.ycombinator.com/item?id={}"),
    ("chatgpt", "https://chatgpt.com/c/{}"), ("claude", "https://claude.ai/chat/{}"), ("grok", "https://x.com/i/grok?c={}"), ("gemini", "https://gemini.google.com/app/{}"), ("github", "https://github.com/o/r/issues/{}"),
    ("linkedin", "https://de.linkedin.com/posts/{}"), ("threads", "https://www.threads.net/@u/post/{}"), ("bluesky", "https://bsky.app/profile/u/post/{}"), ("medium", "https://u.medium.com/{}"), ("substack", "https://u.substack.com/p/{}"),
    ("nytimes", "https://www.nytimes.com/2024/{}"), ("wikipedia", "https://en.wikipedia.org/wiki/{}"), ("mastodon", "https://any.example/@u/{}"), ("discourse", "https://forum.example/t/topic/{}"),
    ("leetcode", "https://leetcode.com/problems/{}"), ("lwn", "https://lwn.net/Articles/{}/"), ("bbcode-data", "https://example.org/{}"),
)


def site_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which handler an address goes to."""
    key = F.col("c_custkey")
    url = F.replace(F.element_at(F.array(*(F.lit(u) for _, u in SITE_URLS)), (key % len(SITE_URLS) + 1).cast("int")), F.lit("{}"), key.cast("string"))
    return read_table(spark, sf_dir, "customer").select("c_custkey", U.route(url).alias("handler"))


def date_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written-out dates read back."""
    said = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "'on' d MMMM yyyy 'at noon'")).otherwise(F.date_format("o_orderdate", "'Posted' MMMM d, yyyy"))
    return read_table(spark, sf_dir, "orders").select("o_orderkey", H.date_of_text(said).alias("published"))


def author_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("c_name")
    said = F.concat(F.when(F.col("c_custkey") % 2 == 0, "By ").otherwise(""), name, F.lit(" and "), F.col("c_mktsegment"), F.when(F.col("c_custkey") % 3 == 0, " - ").otherwise(""))
    return read_table(spark, sf_dir, "customer").select("c_custkey", H.clean_author(said).alias("author"))


def srcset_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    width = lambda k: (F.col("p_size") * k % 97 + 1).cast("string")
    srcset = F.concat(F.lit("/a.png "), width(7), F.lit("w, /b.png "), width(13), F.lit("w, /c.png "), width(31), F.lit("w"))
    return read_table(spark, sf_dir, "part").select("p_partkey", H.best_of_srcset(srcset).alias("src"))


def _sql_score() -> str:
    count = lambda p: f"len(regexp_extract_all(h, '{p}'))"
    has = lambda words: " + ".join(f"contains(h, '{w}')::INT" for w in words)
    words = count(r"[^\x20\x09-\x0D]+")
    base = f"({words} + 5 * {count('<p[^>]*>.*?</p>')})"
    return (
        f"greatest(CASE WHEN {words} > 0 AND {count('<a[^>]*>.*?</a>')} / {words} > 0.5 THEN {base} * 0.5 ELSE {base}::DOUBLE END + 3 * {count('<img[^>]*>')} + 10 * ({has(H.CONTENT_WORDS)})"
        f" - 20 * ({has(NAVIGATION)}) - 30 * ({has(H.OTHER_WORDS)}) + 5 * regexp_matches(h, '{H.DATE}')::INT + 5 * regexp_matches(h, '{H.BYLINE}')::INT, 0.0)::DOUBLE"
    )


_SQL_TAGS = r"""tags AS (
  SELECT page_id, pos, lower(regexp_extract(token, '^<([a-zA-Z][a-zA-Z0-9]*)', 1)) AS tag, regexp_extract(token, ' class="([^"]*)"', 1) AS class, regexp_extract(token, ' id="([^"]*)"', 1) AS id
  FROM (SELECT page_id, unnest(t) AS token, unnest(range(len(t))) AS pos FROM (SELECT page_id, regexp_extract_all(coalesce(html, ''), '(<[^>]+>|[^<]+)', 1) AS t FROM pages))
  WHERE regexp_matches(token, '^<[a-zA-Z]'))"""
_SQL_WORDS = r"len(regexp_extract_all(regexp_replace(coalesce(html, ''), '<[^>]+>', ' ', 'g'), '[^\x20\x09-\x0D]+'))::BIGINT"
_SQL_HOST = r"lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)', 1))"
_SQL_DOMAIN = rf"regexp_replace({_SQL_HOST}, '^(www\.)+', '')"
_SQL_LINKS = "len(regexp_extract_all(coalesce(html, ''), '<a[ >]'))::BIGINT"

QUERIES = {f.__name__: f for f in (
    page_summary, page_body, strip_tags, strip_comments, text_score, attribute_score, tag_histogram, clutter_name_hits, pages_by_host, top_pages_by_links,
    lang_rollup, oversize_pages, ssrf_filter, site_route, date_text, author_cleaned, srcset_best,
)}
ORACLE_SQL = {
    "page_summary": rf"SELECT page_id, trim(regexp_extract(coalesce(html, ''), '<title[^>]*>(.*?)</title>', 1)) AS title, {_SQL_DOMAIN} AS domain, {_SQL_WORDS} AS word_count, {_SQL_LINKS} AS n_links FROM pages",
    "page_body": r"""
SELECT page_id, length(b)::BIGINT AS body_chars, md5(b) AS body_md5 FROM (
  SELECT page_id, CASE WHEN regexp_matches(html, '(?s)<body[^>]*>(.*)</body>') THEN trim(regexp_extract(html, '(?s)<body[^>]*>(.*)</body>', 1)) ELSE coalesce(html, '') END AS b FROM pages)""",
    "strip_tags": r"SELECT page_id, md5(trim(regexp_replace(regexp_replace(coalesce(html, ''), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))) AS text_md5 FROM pages",
    "strip_comments": "SELECT page_id, md5(regexp_replace(coalesce(html, ''), '<!--.*?-->', '', 'g')) AS html_md5 FROM pages",
    "text_score": f"SELECT page_id, {_sql_score()} AS score FROM (SELECT page_id, coalesce(html, '') AS h FROM pages)",
    "attribute_score": f"""
WITH {_SQL_TAGS}
SELECT page_id, pos::BIGINT AS pos, tag, (CASE WHEN tag IN ('article', 'main') THEN 20 WHEN tag = 'section' THEN 10 WHEN tag = 'div' THEN 5 ELSE -20 END
  + 15 * regexp_matches(lower(class), 'content|article|post|entry')::INT - 15 * regexp_matches(lower(class), 'nav|menu|sidebar|comment')::INT
  + 10 * regexp_matches(lower(id), 'content|main')::INT - 10 * regexp_matches(lower(id), 'nav|sidebar')::INT)::DOUBLE AS score
FROM tags WHERE tag IN ('div', 'section', 'article', 'main', 'nav', 'aside', 'footer', 'header')""",
    "tag_histogram": f"WITH {_SQL_TAGS} SELECT tag, count(*) AS n_tags, count(DISTINCT page_id) AS n_pages FROM tags GROUP BY tag",
    "clutter_name_hits": f"WITH {_SQL_TAGS} SELECT page_id, sum({' + '.join(f'''contains(lower(concat_ws(' ', tag, class, id)), '{w}')::INT''' for w in NAVIGATION)})::BIGINT AS n_hits FROM tags GROUP BY page_id",
    "pages_by_host": f"SELECT {_SQL_HOST} AS host, count(*) AS n_pages, sum({_SQL_WORDS})::BIGINT AS words FROM pages GROUP BY 1",
    "top_pages_by_links": f"""
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY n_links DESC, page_id) AS rank FROM (SELECT page_id, {_SQL_DOMAIN} AS domain, {_SQL_LINKS} AS n_links FROM pages)) WHERE rank <= 3""",
    "lang_rollup": f"""
SELECT lang, scheme, count(*) AS n_pages, sum(words)::BIGINT AS words
FROM (SELECT regexp_extract(coalesce(html, ''), '<html lang="([a-z]+)"', 1) AS lang, regexp_extract(url, '^([a-z]+):', 1) AS scheme, {_SQL_WORDS} AS words FROM pages) GROUP BY ROLLUP (lang, scheme)""",
    "oversize_pages": "SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS n_bytes FROM pages WHERE strlen(coalesce(html, '')) <= 5 * 1024 * 1024",
    # of the sixteen kinds of address, in order, these may be fetched: two names, two public addresses
    "ssrf_filter": "SELECT o_orderkey, o_orderkey % 16 IN (1, 7, 15) AS allowed FROM orders",
    "site_route": f"SELECT c_custkey, [{', '.join(repr(n) for n, _ in SITE_URLS)}][c_custkey % {len(SITE_URLS)} + 1] AS handler FROM customer",
    "date_text": "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') || 'T00:00:00+00:00' AS published FROM orders",
    "author_cleaned": "SELECT c_custkey, c_name || ', ' || c_mktsegment AS author FROM customer",
    "srcset_best": """
SELECT p_partkey, CASE WHEN a >= b AND a >= c THEN '/a.png' WHEN b >= c THEN '/b.png' ELSE '/c.png' END AS src
FROM (SELECT p_partkey, p_size * 7 % 97 + 1 AS a, p_size * 13 % 97 + 1 AS b, p_size * 31 % 97 + 1 AS c FROM part)""",
}
