"""Handlers of particular sites, chosen by the page's address, first match first.

A handler returns what it found, or nothing, and the page then goes the general way. Three of them
need a page to be fetched and never run on stored pages: they are listed for their place in the
order only. More handlers can be registered; they come after the others but before the last one.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import UTC, datetime
from html import escape

from pagequern.extract.head import Head, date_of_text
from pagequern.html.dom import Node, inner_html, parse, serialize


@dataclass
class Message:
    author: str | None
    timestamp: str | None
    html: str
    depth: int = 0

    def render(self) -> str:
        by = f'<p class="conversation-author"><strong>{escape(self.author, quote=False)}</strong></p>' if self.author is not None else ""
        at = f'<p class="conversation-timestamp"><em>{escape(self.timestamp, quote=False)}</em></p>' if self.timestamp is not None else ""
        return "<blockquote>" * self.depth + f'<div class="conversation-message">{by}{at}{self.html}</div>' + "</blockquote>" * self.depth


@dataclass
class Found:
    """What a handler found; None leaves the general value."""

    html: str
    title: str | None = None
    author: str | None = None
    site: str | None = None
    published: str | None = None
    description: str | None = None
    messages: list[Message] = field(default_factory=list)
    schema: list[str] = field(default_factory=list)


def render(messages: list[Message]) -> str:
    return '<article class="conversation">' + "".join(m.render() for m in messages) + "</article>"


def attr(n: Node | None, name: str) -> str:
    return n.attrs.get(name, "") if n is not None else ""


def said(n: Node | None) -> str:
    return n.text.strip() if n is not None else ""


def inner(n: Node | None) -> str:
    return inner_html(n) if n is not None else ""


def paragraph(text: str) -> str:
    return f"<p>{escape(text, quote=False)}</p>"


def match(pattern: str, url: str, default: str = "") -> str:
    m = re.search(pattern, url)
    return m[1] if m else default


def thread(root: Node, selector: str, make: Callable[[Node], Message | None], **about) -> Found | None:
    messages = [m for n in root.select(selector) if (m := make(n)) is not None]
    return Found(render(messages), messages=messages, published=messages[0].timestamp, **about) if messages else None


# Posts and threads


def x_article(root: Node, head: Head, url: str) -> Found | None:
    body = root.first("[data-testid=twitterArticleRichTextView]")
    if body is None:
        return None
    by = said(root.first("[itemprop=author]")) or attr(root.first("[itemprop=author] meta[itemprop=name]"), "content") or "@" + match(r"\.com/([A-Za-z0-9_]{1,15})/article/", url, "Unknown")
    title = said(root.first("[data-testid=twitter-article-title]")) or "Untitled X Article"
    return Found(f'<article class="x-article">{inner(body)}</article>', title, by, "X (Twitter)", description=body.text.strip()[:140])


def twitter(root: Node, head: Head, url: str) -> Found | None:
    handle = lambda n: match(r"/([A-Za-z0-9_]{1,15})(?:\Z|/status/)", next((a.attrs.get("href", "") for a in n.select("[data-testid=User-Name] a")), ""))
    main, depth = None, 0
    messages = []
    for n in root.select("article[data-testid=tweet]"):
        by = ("@" + h) if (h := handle(n)) else ""
        main = by if main is None else main
        depth = 0 if by == main else depth + 1
        messages.append(Message(by or None, attr(n.first("time"), "datetime") or None, paragraph(said(n.first("[data-testid=tweetText]"))), depth))
    own = main or "@" + match(r"/([A-Za-z0-9_]{1,15})/status/\d+", url, "Unknown")
    return Found(render(messages), f"{own} on X", own, "X (Twitter)", messages[0].timestamp, messages[0].html[:140], messages) if messages else None


def reddit(root: Node, head: Head, url: str) -> Found | None:
    post, old = root.first("shreddit-post"), root.first(".thing.link")
    if post is None and old is None:
        return None
    if post is not None:
        title, by, at, body = attr(post, "post-title"), attr(post, "author"), attr(post, "created-timestamp"), post.first("[slot=text-body]")
        comments = [Message(c.attrs.get("author"), c.attrs.get("created"), serialize(b) if (b := c.first("[slot=comment]")) is not None else "", int(c.attrs.get("depth", "0") or 0)) for c in root.all("shreddit-comment")]
    else:
        title, by, at, body = said(root.first(".thing.link a.title")), attr(old, "data-author"), attr(old.first("time"), "datetime"), root.first(".thing.link .usertext-body .md")
        comments = [
            Message(c.attrs.get("data-author"), attr(c.first(".entry .tagline time"), "datetime") or None, serialize(b) if (b := c.first(".entry .usertext-body .md")) is not None else "", sum("child" in a.classes for a in c.up()))
            for c in root.select(".thing.comment")
        ]
    html = f'<article class="reddit-post">{inner(body)}</article>' + (f"<hr/>{render(comments)}" if comments else "")
    sub = match(r"/r/([^/]+)", url)
    return Found(html, title or None, by or None, f"r/{sub}" if sub else "Reddit", at or None, said(body)[:140], comments)


def hackernews(root: Node, head: Head, url: str) -> Found | None:
    listing = root.select("tr.athing")
    story = root.first(".fatitem")
    link = lambda n: n.first(".titleline a")
    if story is None:
        items = [f'<li><a href="{escape(attr(a, "href"))}">{escape(said(a), quote=False)}</a></li>' for n in listing if (a := link(n)) is not None]
        return Found(f"<ol>{''.join(items)}</ol>", said(root.first("title")) or None, site="Hacker News") if items else None
    if story.first(".onstory") is not None and (text := story.first(".commtext")) is not None:
        by, day, line = said(story.first(".hnuser")), attr(story.first(".age"), "title").split("T")[0], " ".join(text.text.split())
        html = f"<p><strong>{escape(by, quote=False)}</strong>{' · ' + day if day else ''}</p>{inner(text)}"
        return Found(html, f"Comment by {by}: {line if len(line) <= 50 else line[:50] + '...'}", by or None, "Hacker News", day or None)
    comments, seen = [], set()
    for c in root.select("tr.comtr"):
        text, key = c.first(".commtext"), c.attrs.get("id", "")
        if text is None or not key or key in seen:
            continue
        seen.add(key)
        width = attr(c.first(".ind img"), "width")
        depth = int(width) // 40 if width.isdigit() else 0
        by, day = said(c.first(".hnuser")) or "[deleted]", attr(c.first(".age"), "title").split("T")[0]
        comments.append((Message(by, day or None, inner(text), depth), f"<p><strong>{escape(by, quote=False)}</strong>{' · ' + day if day else ''}</p>{inner(text)}"))
    listed = "".join("<blockquote>" * (m.depth + 1) + html + "</blockquote>" * (m.depth + 1) for m, html in comments)
    a, top = link(story), story.first(".toptext") or story.first(".commtext")
    html = (f'<p><a href="{escape(attr(a, "href"))}">{escape(said(a), quote=False)}</a></p>' if a is not None else "") + inner(top) + (f"<hr><h2>Comments</h2>{listed}" if listed else "")
    return Found(html, said(a) or said(root.first("title")) or None, said(story.first(".hnuser")) or None, "Hacker News", attr(story.first(".age"), "title").split(" ")[0] or None, messages=[m for m, _ in comments])


def chat(name: str, messages: list[Message]) -> Found:
    """A chat is a result even without a message. The first line that the reader wrote is the title."""
    first = next((parse(m.html).text for m in messages if (m.author or "").lower() in ("you", "user")), "")
    line = first.strip().split("\n")[0].strip()
    title = line if len(line) <= 80 else line[:80] + "..."
    return Found(render(messages), title or None, site=name, messages=messages)


def chatgpt(root: Node, head: Head, url: str) -> Found:
    names = {"user": "You", "assistant": "ChatGPT", "system": "System"}
    return chat("ChatGPT", [Message(names.get(r := n.attrs["data-message-author-role"], r), None, inner(n)) for n in root.select("[data-message-author-role]")])


def claude(root: Node, head: Head, url: str) -> Found:
    found = root.select("[data-testid=user-message], [data-testid=assistant-message], .font-claude-response")
    kept = [n for n in found if not any(a in found for a in n.up())]
    return chat("Claude", [Message("You" if attr(n, "data-testid") == "user-message" else "Claude", None, inner(n.first(".standard-markdown") or n)) for n in kept])


def grok(root: Node, head: Head, url: str) -> Found:
    rows = [n for n in root.select(".relative.group.flex.flex-col.justify-center.w-full") if n.first(".message-bubble") is not None]
    return chat("Grok", [Message("You" if "items-end" in n.classes else "Grok", None, inner(n.first(".message-bubble"))) for n in rows])


def gemini(root: Node, head: Head, url: str) -> Found:
    parts = [p for c in root.select("div.conversation-container") for p in (("You", c.first("user-query .query-text") or c.first("user-query")), ("Gemini", c.first("model-response .model-response-text") or c.first("model-response"))) if p[1] is not None]
    return chat("Gemini", [Message(by, None, inner(n)) for by, n in parts])


def github(root: Node, head: Head, url: str) -> Found | None:
    if not root.select(".js-header-wrapper, #js-repo-pjax-container, meta[name=expected-hostname], meta[name=octolytics-url], [data-testid=issue-viewer-container]"):
        return None
    m = re.search(r"github\.com/([^/?#]+)/([^/?#]+)", url)
    site = f"GitHub - {m[1]}/{m[2]}" if m else "GitHub"
    bodies = root.select(".comment-body.markdown-body, [data-testid=issue-body] .markdown-body, [data-testid=markdown-body]")
    if re.search(r"/(?:issues|pull)/\d+", url) and bodies:
        comments = [Message(said(c.first(".author")) or None, attr(c.first("relative-time"), "datetime") or None, inner(b)) for c in root.select(".timeline-comment, .review-comment") if (b := c.first(".comment-body")) is not None and b is not bodies[0]]
        listed = "".join(f"<blockquote><p><strong>{escape(c.author or '', quote=False)}</strong></p>{c.html}</blockquote>" for c in comments)
        title = said(root.first("[data-testid=issue-title]")) or said(root.first(".js-issue-title"))
        by = said(root.first("[data-testid=issue-body-header-author]")) or said(root.first(".author"))
        return Found(inner(bodies[0]) + (f"<hr><h2>Comments</h2>{listed}" if listed else ""), title or None, by or None, site, attr(root.first("relative-time"), "datetime") or None, messages=comments)
    readme = root.first("article.markdown-body")
    return Found(inner(readme), site=site, schema=["{}"]) if readme is not None else None


def linkedin(root: Node, head: Head, url: str) -> Found | None:
    post = next((n for n in root.select("[role=article].feed-shared-update-v2")), None)
    if post is None:
        return None
    by = post.first(".update-components-actor__title")
    for n in by.select(".visually-hidden") if by is not None else ():
        n.detach()
    text = said(post.first(".update-components-text"))
    return Found(f'<article class="linkedin-post">{paragraph(text)}</article>', f"LinkedIn post by {said(by)}" if said(by) else "LinkedIn post", said(by) or None, "LinkedIn", description=text[:140])


def threads(root: Node, head: Head, url: str) -> Found | None:
    handle = "@" + match(r"/@([^/?#]+)", url, "Unknown")

    def make(n: Node) -> Message | None:
        text = " ".join(s for x in n.select("span[dir=auto]") if (s := x.text.strip()))
        by = match(r"/@([^/]+)", attr(n.first("a[href^='/@']"), "href"))
        return Message(f"@{by}" if by else None, attr(n.first("time"), "datetime") or None, paragraph(text)) if text else None

    return thread(root, "[data-pressable-container]", make, title=f"{handle} on Threads", author=handle, site="Threads")


def bluesky(root: Node, head: Head, url: str) -> Found | None:
    def make(n: Node) -> Message:
        lines = [d for d in n.all("div") if "background-color" in d.attrs.get("style", "") and re.search(r"width:\s*2px", d.attrs.get("style", ""))]
        return Message(n.attrs["data-testid"].removeprefix("postThreadItem-by-"), attr(n.first("time"), "datetime") or None, paragraph(said(n.first("div[data-word-wrap='1']"))), len(lines))

    by = match(r"/profile/([^/?#]+)", url, "Unknown")
    return thread(root, "[data-testid^=postThreadItem-by-]", make, title=f"{by} on Bluesky", author=by, site="Bluesky")


# Articles


def medium(root: Node, head: Head, url: str) -> Found | None:
    body = root.first("article.meteredContent") or root.first("article")
    if body is None:
        return None
    title = said(body.first("h1"))
    for n in body.select("[data-testid=authorName], [data-testid=storyReadTime], [data-testid=storyPublishDate], [data-testid=headerClapButton], figure [role=tooltip], button"):
        n.detach()
    return Found(inner(body), title or None, said(root.first("[data-testid=authorName]")) or head.of("n:author") or None, "Medium", head.of("p:article:published_time") or None, said(body.first(".pw-subtitle-paragraph")) or None)


def substack(root: Node, head: Head, url: str) -> Found | None:
    post, note = root.first("div.body.markup"), root.first("div.ProseMirror.FeedProseMirror")
    if post is not None:
        return Found(inner(post), said(root.first("h1.post-title")) or None, said(root.first(".byline-name")) or head.of("n:author") or None, "Substack")
    if note is not None:
        by = re.sub(r"\s*\(@[^)]+\)\s*\Z", "", head.of("p:og:title"))
        return Found(inner(note), f"Note by {by}" if by else None, by or None, "Substack")
    return Found("", head.of("p:og:title"), head.of("n:author") or None, "Substack", description=head.of("p:og:description") or None) if head.of("p:og:site_name") == "Substack" else None


def _nyt_inline(parts: list[dict]) -> str:
    out = ""
    for p in parts or ():
        text = escape(p.get("text", ""), quote=False)
        for f in p.get("formats") or ():
            kind = f.get("__typename")
            text = f"<strong>{text}</strong>" if kind == "BoldFormat" else f"<em>{text}</em>" if kind == "ItalicFormat" else f'<a href="{escape(f.get("url", ""))}">{text}</a>' if kind == "LinkFormat" else text
        out += text
    return out


def nytimes(root: Node, head: Head, url: str) -> Found | None:
    script = next((s.text for s in root.all("script") if "window.__preloadedData" in s.text), "")
    try:
        data = json.loads(re.sub(r":\s*undefined\b", ":null", script[script.index("{") : script.rindex("}") + 1]))
        article = next(v for v in (data.get("initialData", {}).get("data", {}) or data).values() if isinstance(v, dict) and "sprinkledBody" in v)
        blocks = article["sprinkledBody"]["content"]
    except (ValueError, StopIteration, KeyError, TypeError, AttributeError):
        return None
    tags, out = {"ParagraphBlock": "p", "Heading2Block": "h2", "Heading3Block": "h3", "Heading4Block": "h4"}, []
    for b in blocks:
        kind = b.get("__typename")
        if kind in tags:
            out.append(f"<{tags[kind]}>{_nyt_inline(b.get('content'))}</{tags[kind]}>")
        elif kind == "ImageBlock":
            media = b.get("media") or {}
            sizes = [r for c in media.get("crops") or () for r in c.get("renditions") or ()]
            if sizes:
                caption = (media.get("caption") or {}).get("text", "")
                best = max(sizes, key=lambda r: r.get("width", 0))
                out.append(f'<figure><img src="{escape(best["url"])}" alt="{escape(media.get("altText") or "")}"><figcaption>{escape(caption, quote=False)}</figcaption></figure>')
    names = [c.get("displayName", "") for x in article.get("bylines") or () for c in x.get("creators") or ()]
    title = (article.get("headline") or {}).get("default")
    return Found("".join(out), title, ", ".join(filter(None, names)) or None, "The New York Times", article.get("firstPublished"), article.get("summary")) if out else None


def wikipedia(root: Node, head: Head, url: str) -> Found | None:
    body = root.first(".mw-parser-output") or root.first("#mw-content-text")
    if body is None:
        return None
    for n in body.select(".mw-editsection, .navbox, .infobox, .toc, #toc, .reflist, .references, .reference, .hatnote, .sistersitebox, .portalbox, .mbox-small, .mw-empty-elt, .thumbcaption .magnify"):
        n.detach()
    title = said(root.first("h1#firstHeading")) or re.sub(r"\s+[-–—]\s+Wikipedia\Z", "", head.title or "")
    return Found(inner(body), title or None, None, "Wikipedia")


def mastodon(root: Node, head: Head, url: str) -> Found | None:
    if not ("mastodon" in head.of("n:generator").lower() or root.select("#mastodon, script#initial-state")):
        return None

    def make(n: Node) -> Message:
        return Message(said(n.first(".display-name__account")) or None, attr(n.first("time"), "datetime") or None, inner(n.first(".status__content__text")))

    by = said(root.first(".display-name__html")) or "@" + match(r"/@([^/]+)/", url)
    return thread(root, ".detailed-status__wrapper, .status__wrapper", make, title=f"{by} on Mastodon", author=by, site="Mastodon")


def discourse(root: Node, head: Head, url: str) -> Found | None:
    if "discourse" not in head.of("n:generator").lower():
        return None

    def make(n: Node) -> Message:
        by = n.first(".names a[data-user-card]")
        return Message(attr(by, "data-user-card") or None, attr(n.first("time"), "datetime") or None, inner(n.first(".cooked")))

    title = said(root.first(".fancy-title")) or said(root.first("h1[data-topic-id]")) or head.of("p:og:title")
    return thread(root, ".topic-post", make, title=title or None, site=head.of("p:og:site_name") or "Discourse")


def leetcode(root: Node, head: Head, url: str) -> Found | None:
    body = root.first("[data-track-load=description_content]")
    if body is None:
        return None
    for n in body.select(".premium-content, .lock-icon"):
        n.detach()
    return Found(inner(body), said(root.first("[class*=text-title-large]")) or None, site="LeetCode")


def lwn(root: Node, head: Head, url: str) -> Found | None:
    body, top = root.first(".ArticleText main") or root.first(".ArticleText"), root.first(".PageHeadline h1") or root.first(".PageHeadline")
    if body is None and top is None:
        return None
    boxes = root.select("details.CommentBox")
    comments = [Message(said(c.first(".CommentPoster")).removeprefix("Posted by ") or None, None, inner(c.first(".FormattedComment")), sum("CommentBox" in a.classes for a in c.up())) for c in boxes]
    for n in boxes:
        n.detach()
    by = said(root.first(".Byline"))
    listed = "".join("<blockquote>" * (c.depth + 1) + f"<p><strong>{escape(c.author or '', quote=False)}</strong></p>{c.html}" + "</blockquote>" * (c.depth + 1) for c in comments)
    posted = date_of_text(match(r"(?:Posted\s+)?([A-Z]\w+\s+\d+,\s+\d{4})", by))
    return Found(inner(body) + (f"<hr><h2>Comments</h2>{listed}" if listed else ""), said(top) or None, match(r"\bby\s+(.+)\Z", by) or None, "LWN.net", posted, messages=comments)


# BBCode, on any site


def unix_time(seconds: int) -> str:
    return datetime.fromtimestamp(seconds, UTC).strftime("%Y-%m-%dT%H:%M:%S.000Z")


def bbcode_to_html(source: str) -> str:
    """The usual tags as HTML; links with script addresses lose them, unknown tags go, line ends become breaks."""
    rules: list[tuple[str, str | Callable[[re.Match], str]]] = [(rf"\[h{i}\](.*?)\[/h{i}\]", rf"<h{i}>\1</h{i}>") for i in (1, 2, 3, 4)]
    rules += [(rf"\[{b}\](.*?)\[/{b}\]", rf"<{t}>\1</{t}>") for b, t in (("b", "strong"), ("i", "em"), ("u", "u"), ("s", "s"))]
    rules += [(r"\[size=([^\]]+)\](.*?)\[/size\]", r'<span style="font-size:\1">\2</span>'), (r"\[color=([^\]]+)\](.*?)\[/color\]", r'<span style="color:\1">\2</span>')]

    def link(m: re.Match) -> str:
        href = m[1].replace('\\"', "").strip()
        return m[2] if re.match(r"(?i)\s*(?:javascript|data|vbscript):", href) else f'<a href="{href}">{m[2]}</a>'

    def items(tag: str) -> Callable[[re.Match], str]:
        return lambda m: f"<{tag}>{''.join(f'<li>{x.strip()}</li>' for x in m[1].split('[*]')[1:])}</{tag}>"

    rules += [
        (r"""\[url=["']?([^"'\]]+)["']?\](.*?)\[/url\]""", link), (r"\[img\](.*?)\[/img\]", r'<img src="\1">'),
        (r"""\[previewyoutube=["']?([^;'"\]]+)[^"'\]]*["']?\]\[/previewyoutube\]""", r'<img src="https://www.youtube.com/watch?v=\1">'),
        (r"\[list\](.*?)\[/list\]", items("ul")), (r"\[olist\](.*?)\[/olist\]", items("ol")), (r"\[quote(?:=[^\]]+)?\](.*?)\[/quote\]", r"<blockquote>\1</blockquote>"),
        (r"\[code\](.*?)\[/code\]", r"<pre><code>\1</code></pre>"), (r"\[spoiler\](.*?)\[/spoiler\]", r"<details><summary>Spoiler</summary>\1</details>"),
        (r"\[p\](.*?)\[/p\]", lambda m: "<p>" + m[1].replace("\n", "<br>") + "</p>"),
    ]
    for pattern, to in rules:
        source = re.sub("(?is)" + pattern, to, source)
    return re.sub(r"\[[^\]]+\]", "", source.replace("\n", "<br>"))


def bbcode(root: Node, head: Head, url: str) -> Found | None:
    """An event in the page's configuration, or the code or text block with the most tags, three at least."""
    config = root.first("#application_config")
    try:
        event = json.loads(attr(config, "data-partnereventstore"))[0]
        body = event.get("announcement_body") or {}
        html, at = bbcode_to_html(body.get("body") or ""), body.get("posttime")
        if html:
            title = event.get("event_name") or body.get("headline")
            return Found(html, title, event.get("group_name"), "", unix_time(int(at)) if at else None)
    except (ValueError, LookupError, TypeError, AttributeError):
        pass
    count = lambda s: len(re.findall(r"(?i)\[/?(?:[a-z][a-z0-9_]*|\*)(?:=[^\]]*)?\]", s))
    texts = [n.text for t in ("pre", "code", "textarea") for n in root.all(t)]
    best = max(texts, key=count, default="")
    if count(best) < 3:
        return None
    title = next((s for p in (r"\[h1\](.*?)\[/h1\]", r"\[size=[^\]]+\](.*?)\[/size\]") if (m := re.search("(?is)" + p, best)) and (s := re.sub(r"\[[^\]]+\]", "", m[1]).strip())), None)
    return Found(bbcode_to_html(best), title)


# Routes: name, address pattern (Java and Python read them alike), handler; no handler: needs a fetch

_HOST = r"^https?://(?:[^/@?#]*@)?(?:www\.)?"
_SUB = r"^https?://(?:[^/@?#]*@)?(?:[^/?#]+\.)?"
_END = r"(?:[:/?#]|$)"
ROUTES: list[tuple[str, str, Callable[[Node, Head, str], Found | None] | None]] = [
    ("x-article", r"(?i)^https?://(?:www\.|mobile\.)?(?:x|twitter)\.com/(?:[A-Za-z0-9_]{1,15}|i)/article/\d+", x_article),
    ("twitter", r"(?i)^https?://(?:www\.|mobile\.)?(?:x|twitter)\.com/[A-Za-z0-9_]{1,15}/status/\d+", twitter),
    ("x-oembed", r"(?i)^https?://(?:www\.|mobile\.)?(?:x|twitter)\.com/", None),
    ("reddit", r"(?i)^https?://(?:[a-z0-9-]+\.)?reddit\.com/r/[^/]+/comments/[A-Za-z0-9]+/?", reddit),
    ("youtube", _HOST + r"(?:m\.)?(?:youtube\.com|youtu\.be)" + _END, None),
    ("hackernews", _HOST + r"news\.ycombinator\.com" + _END, hackernews),
    ("chatgpt", _HOST + r"(?:chatgpt\.com|chat\.openai\.com)" + _END, chatgpt),
    ("claude", _HOST + r"claude\.ai" + _END, claude),
    ("grok", _HOST + r"(?:grok\.com" + _END + r"|(?:x|twitter)\.com/i/grok)", grok),
    ("gemini", _HOST + r"(?:gemini|bard)\.google\.com" + _END, gemini),
    ("github", _HOST + r"github\.com" + _END, github),
    ("linkedin", r"(?i)^https?://(?:[a-z]+\.)?linkedin\.com/", linkedin),
    ("threads", r"(?i)^https?://(?:www\.)?threads\.(?:net|com)/", threads),
    ("bluesky", r"(?i)^https?://(?:www\.)?bsky\.app/", bluesky),
    ("medium", _SUB + r"medium\.com" + _END, medium),
    ("c2_wiki", _HOST + r"(?:wiki\.)?c2\.com" + _END, None),
    ("substack", _SUB + r"substack\.com" + _END, substack),
    ("nytimes", _SUB + r"nytimes\.com" + _END, nytimes),
    ("wikipedia", _SUB + r"wikipedia\.org" + _END, wikipedia),
    ("mastodon", r"/@[^/]+/\d+", mastodon),
    ("discourse", r"/t/[^/]+/\d+", discourse),
    ("leetcode", _HOST + r"leetcode\.com" + _END, leetcode),
    ("lwn", _HOST + r"lwn\.net" + _END, lwn),
    ("bbcode-data", "", bbcode),
]


def register(name: str, pattern: str, handler: Callable[[Node, Head, str], Found | None]) -> None:
    """Adds a handler for addresses that match the pattern, just before the one for any page."""
    ROUTES.insert(len(ROUTES) - 1, (name, pattern, handler))


def route(url: str | None) -> tuple[str, Callable[[Node, Head, str], Found | None]]:
    return next((name, handler) for name, pattern, handler in ROUTES if handler is not None and (not pattern or re.search(pattern, url or "")))
