"""Plain text of HTML, and scores of text and blocks."""

from __future__ import annotations

import re

from pagequern.html.dom import HEADINGS, Node, body_of, parse

_SENTENCE = re.compile(r"[.!?。！？]")
_BYLINE = re.compile(r"(?i)\s*by\s+\w")
_DATE = re.compile(r"(?i)(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\s+\d{1,2}|\d{4}[-/]\d{1,2}[-/]\d{1,2}")


def count_words(html: str) -> int:
    return len(re.sub(r"<[^>]+>", " ", html).split())


def strip_tags(html: str) -> str:
    return " ".join(re.sub(r"<[^>]+>", " ", html).split())


def html_to_text(html: str) -> str:
    """Text with line breaks at blocks, bullets before items and the names of images."""
    out: list[str] = []

    def visit(n: Node) -> None:
        if n.tag == "#text":
            out.append(re.sub(r"\s+", " ", n.data))
        elif n.tag in ("script", "style", "noscript") or not n.element and n.tag != "#document":
            return
        elif n.tag == "img":
            out.append(f"[Image: {n.attrs['alt']}]" if n.attrs.get("alt") else "")
        else:
            block = n.tag in ("p", "div", "article", "section", "blockquote", *HEADINGS)
            out.append("\n" if n.tag == "br" or block or n.tag == "li" else "")
            out.append("\n" if n.tag in HEADINGS else "• " if n.tag == "li" else "")
            for c in n.children:
                visit(c)
            out.append("\n" if block else "")

    visit(body_of(parse(html)))
    lines = [" ".join(line.split()) for line in "".join(out).split("\n")]
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()


def is_prose(n: Node) -> bool:
    said = n.text.strip()
    words, total = len(said.split()), len(said.encode())
    links = sum(len(a.text.encode()) for a in n.all("a"))
    if words < 7 or not _SENTENCE.search(said) or links > 0.7 * total:
        return False
    return not (_BYLINE.match(said) and words < 15 or _DATE.search(said) and words < 20)


def content_start(root: Node, title: str = "") -> Node | None:
    """The first block of prose after the heading that is the title, else the first anywhere."""
    found, want = root.all("p", "div", "section", "blockquote", "li", *HEADINGS), " ".join(title.lower().split())
    at = next((i for i, n in enumerate(found) if want and n.tag in HEADINGS and " ".join(n.text.lower().split()) == want), -1)
    prose = lambda ns: next((n for n in ns if n.tag not in HEADINGS and is_prose(n) and not any(is_prose(c) for c in n.all("p"))), None)
    return prose(found[at + 1 :]) or prose(found)
