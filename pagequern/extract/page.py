"""One page to one record."""

from __future__ import annotations

import re
import time
from typing import Any

from pagequern.extract import cleanup, sites, standardize
from pagequern.extract.head import collect, metadata
from pagequern.extract.markdown import html_to_markdown
from pagequern.extract.options import Options
from pagequern.extract.text import count_words
from pagequern.html.dom import Node, body_of, inner_html, parse, serialize

#: Below so many words a page is read again without removals.
FEW_WORDS = 200
#: The second reading counts if it has twice the words, or any more if there were fewer than this.
HARDLY_ANY = 30


def body_html(html: str) -> str:
    """From the first body tag to the last end of one; without them the whole page."""
    m = re.search(r"(?s)<body[^>]*>(.*)</body>", html)
    return m[1].strip() if m else html


def first_image(html: str) -> str:
    """The first image of 50 pixels or of unknown size that isn't inline."""
    side = lambda v: int(v) if v.isdigit() else 100
    for n in parse(html).all("img") if "<img" in html else ():
        src = n.attrs.get("src", "")
        if src and not src.startswith("data:") and min(side(n.attrs.get("width", "")), side(n.attrs.get("height", ""))) >= 50:
            return src
    return ""


def clean_content(document: Node, url: str | None, options: Options, removals: bool) -> str:
    """The body that read_body() made as a document of its cleaned content; the given tree is used up."""
    body = body_of(document)
    if removals:
        cleanup.remove_clutter(body, options)
    standardize.callouts(body)
    document = parse("<body>" + standardize.plain_wrappers(inner_html(body), options.debug))
    if removals and (options.remove_exact_selectors or options.remove_partial_selectors):
        cleanup.before_standardizing(document, options)
    standardize.dom_passes(document, url)
    cleanup.after_standardizing(document)
    return serialize(document)


def read_body(html: str) -> Node:
    return parse("<body>" + standardize.noscript_images(body_html(html)))


def extract(html: str | None, url: str | None = None, options: Options = Options()) -> dict[str, Any]:
    """All fields of a page. An empty string is a missing value; a page that can't be read gives _error."""
    began = time.monotonic()
    html = html or ""
    document = parse(html)
    head = collect(document)
    record: dict[str, Any] = {"extractor_type": None, "content_markdown": None, "_error": None, "meta_tags": head.meta, **metadata(head, url)}
    name, handler = sites.route(url)
    found = handler(document, head, url or "")
    if found is not None:
        record["extractor_type"], content = name, found.html
        given = {"title": found.title, "author": found.author, "site": found.site, "published": found.published, "description": found.description}
        record |= {k: v for k, v in given.items() if v is not None}
        record["schema_org_data"] = record["schema_org_data"] + found.schema
    else:
        body = read_body(html)
        content = clean_content(body.copy(), url, options, True)
        words = count_words(content)
        if words < FEW_WORDS and (options.remove_exact_selectors or options.remove_partial_selectors):
            again = clean_content(body, url, options, False)
            more = count_words(again)
            content = again if more > 2 * words or words < HARDLY_ANY and more > words else content
        record["image"] = record["image"] or first_image(content)
    record["word_count"] = count_words(content)
    if options.markdown or options.separate_markdown:
        markdown = html_to_markdown(content, record["title"], url)
        record["content_markdown"] = markdown if options.separate_markdown else None
        content = markdown if options.markdown else content
    return record | {"content": content, "parse_time": int((time.monotonic() - began) * 1000)}


def messages(html: str | None, url: str | None = None) -> list[sites.Message]:
    """The messages of a thread or chat; none if the page isn't one."""
    document: Node = parse(html or "")
    found = sites.route(url)[1](document, collect(document), url or "")
    return found.messages if found is not None else []
