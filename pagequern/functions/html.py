"""Of HTML text: titles, bodies, words, scores, names of clutter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagequern.extract.cleanup import NAVIGATION, PARTIAL

# Words that raise or lower a text's score.
CONTENT_WORDS = ("admonition", "article", "content", "entry", "image", "img", "font", "figure", "figcaption", "pre", "main", "post", "story", "table")
OTHER_WORDS = (
    "ad", "banner", "cookie", "copyright", "footer", "header", "homepage", "menu", "nav", "newsletter", "popular", "privacy",
    "recommended", "related", "rights", "share", "sidebar", "social", "sponsored", "subscribe", "terms", "trending", "widget",
)
# A written date and a byline.
DATE = r"\b(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\s+\d{1,2},?\s+\d{4}\b"
BYLINE = r"\b(?:by|written by|author:)\s+[A-Za-z\s]+\b"


def title_of(html: Column) -> Column:
    return F.trim(F.regexp_extract(html, "<title[^>]*>(.*?)</title>", 1))


def body_of(html: Column) -> Column:
    """From the first body tag to the last end of one, trimmed; without both the whole page."""
    pattern = r"(?s)<body[^>]*>(.*)</body>"
    return F.when(html.rlike(pattern), F.trim(F.regexp_extract(html, pattern, 1))).otherwise(html)


def without_comments(html: Column) -> Column:
    """Comments of one line go; longer ones stay."""
    return F.regexp_replace(html, "<!--.*?-->", "")


def strip_tags(html: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(html, "<[^>]+>", " "), r"\s+", " "))


def count_words(html: Column) -> Column:
    return F.regexp_count(F.regexp_replace(html, "<[^>]+>", " "), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def count_links(html: Column) -> Column:
    return F.regexp_count(html, F.lit("<a[ >]")).cast("long")


def tokens(html: Column) -> Column:
    """Tags and the texts between them, in order."""
    return F.regexp_extract_all(html, F.lit("(<[^>]+>|[^<]+)"), F.lit(1))


def embed_links(html: Column) -> Column:
    """Video frames as links."""
    frame = r'<iframe[^>]*src="https?://(?:www\.)?youtube\.com/embed/([A-Za-z0-9_-]+)[^"]*"[^>]*></iframe>'
    return F.regexp_replace(html, frame, '<a href="https://www.youtube.com/watch?v=$1">YouTube: $1</a>')


def clutter_names(value: Column, patterns: tuple[str, ...] = PARTIAL) -> Column:
    """The substrings of a class or id that mark clutter."""
    return F.filter(F.array(*map(F.lit, patterns)), lambda p: F.contains(F.lower(value), p))


def navigation_hits(value: Column) -> Column:
    return F.size(F.filter(F.array(*map(F.lit, NAVIGATION)), lambda p: F.contains(F.lower(value), p)))


def score_text(text: Column) -> Column:
    """Words, paragraphs and images against links and the words of menus; 0 at least."""
    count = lambda p: F.regexp_count(text, F.lit(p))
    has = lambda words: sum((F.contains(text, F.lit(w)).cast("int") for w in words), F.lit(0))
    words = count(r"[^\x20\x09-\x0D]+")
    base = words + 5 * count("<p[^>]*>.*?</p>")
    base = F.when((words > 0) & (count("<a[^>]*>.*?</a>") / words > 0.5), base * 0.5).otherwise(base.cast("double"))
    marks = 5 * text.rlike(DATE).cast("int") + 5 * text.rlike(BYLINE).cast("int")
    score = base + 3 * count("<img[^>]*>") + 10 * has(CONTENT_WORDS) - 20 * has(NAVIGATION) - 30 * has(OTHER_WORDS) + marks
    return F.greatest(score, F.lit(0.0))


def score_attributes(tag: Column, cls: Column, own_id: Column) -> Column:
    """A block's score by tag, class and id."""
    has = lambda c, *words: F.coalesce(F.lower(c).rlike("|".join(words)), F.lit(False))
    by_tag = F.when(tag.isin("article", "main"), 20).when(tag == "section", 10).when(tag == "div", 5).when(tag.isin("nav", "aside", "footer", "header"), -20).otherwise(0)
    points = [(15, has(cls, "content", "article", "post", "entry")), (-15, has(cls, "nav", "menu", "sidebar", "comment")), (10, has(own_id, "content", "main")), (-10, has(own_id, "nav", "sidebar"))]
    return sum((n * p.cast("int") for n, p in points), by_tag).cast("double")


def valid(value: Column) -> Column:
    """Neither empty nor a leftover of a template."""
    return (F.length(value) > 0) & ~value.rlike(r"[{}]") & ~value.rlike("^#[A-Za-z]") & value.rlike(r"[\p{L}\p{N}]")


def first_valid(*values: Column) -> Column:
    return F.coalesce(*(F.when(valid(v), v) for v in values), F.lit(""))


def clean_author(value: Column) -> Column:
    """Without a leading "by", addresses and a trailing dash; "and" becomes a comma."""
    for pattern, to in ((r"(?i)^by ", ""), (r"(?i)\(?\s*https?://\S+\s*\)?", ""), (r"(?i),?\s+and\s+", ", "), (r"\s*[-–—|]\s*$", "")):
        value = F.regexp_replace(value, pattern, to)
    return F.trim(value)


def date_of_text(text: Column) -> Column:
    """The first written-out date as an ISO time at midnight, or null."""
    from pagequern.extract.head import MONTHS

    month = "|".join(MONTHS)
    number = F.create_map(*(F.lit(x) for i, m in enumerate(MONTHS, 1) for x in (m, f"{i:02}")))

    def of(pattern: str, d: int, m: int) -> Column:
        part = lambda i: F.regexp_extract(text, pattern, i)
        return F.when(text.rlike(pattern), F.concat(part(3), F.lit("-"), number[F.lower(part(m))], F.lit("-"), F.lpad(part(d), 2, "0"), F.lit("T00:00:00+00:00")))

    return F.coalesce(of(rf"(?i)\b(\d{{1,2}})\s+({month})\s+(\d{{4}})\b", 1, 2), of(rf"(?i)\b({month})\s+(\d{{1,2}}),?\s+(\d{{4}})\b", 2, 1))


def best_of_srcset(srcset: Column) -> Column:
    """The address of the entry with the largest width or density, the first of equals."""
    entries = F.transform(F.split(srcset, r",\s+"), lambda e: F.split(F.trim(e), r"\s+"))
    weight = lambda e: F.coalesce(F.regexp_extract(F.get(e, F.lit(1)), r"^([\d.]+)[wx]$", 1).try_cast("double"), F.lit(0.0)) * F.when(F.get(e, F.lit(1)).endswith("x"), 1000).otherwise(1)
    rated = F.transform(entries, lambda e, i: F.struct(weight(e).alias("weight"), (-i).alias("place"), F.get(e, F.lit(0)).alias("url")))
    return F.array_max(rated)["url"]
