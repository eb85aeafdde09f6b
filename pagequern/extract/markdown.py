"""Markdown of an HTML tree."""

from __future__ import annotations

import re
import sys
from urllib.parse import urljoin

from pagequern.extract.standardize import best_of_srcset, code_text, language_of
from pagequern.html.dom import DEEPEST, HEADINGS, Node, body_of, parse, serialize

# Elements by the way they are rendered.
SKIPPED = frozenset("script style noscript template".split())
SURROUND = {"strong": "**", "b": "**", "em": "*", "i": "*", "del": "~~", "s": "~~", "strike": "~~", "mark": "=="}
INLINE_IN_ITEM = frozenset("a abbr b bdi bdo cite code data del dfn em i img ins kbd label mark math q ruby s samp small span strike strong sub sup time tt u var input button".split())
AS_BLOCK = frozenset("span a em i strong b mark sub sup u small del s strike q kbd samp var time abbr cite".split())


def escaped(s: str) -> str:
    """Backslashes before what Markdown would read: code ticks, brackets, and underscores within words."""
    s = re.sub(r"([\\`\[\]])", r"\\\1", s)
    return re.sub(r"(?<=[^\W_])_(?=[^\W_])", r"\\_", s)


def cell_text(s: str) -> str:
    return re.sub(" +", " ", s.replace("|", "\\|").replace("\n", " ").replace("\r", " ")).strip()


def inline_text(s: str) -> str:
    return escaped(re.sub(r"\s+", " ", s.replace("\ufeff", "")))


def latex_of(n: Node) -> str:
    tex = next((a.text.strip() for a in n.all("annotation") if a.attrs.get("encoding") == "application/x-tex"), "")
    return n.attrs.get("data-latex") or n.attrs.get("alttext") or tex or n.text.strip()


def href_of(n: Node) -> str:
    """The address of a link; a bare host gets its slash, scripts none."""
    href = n.attrs.get("href", "").strip()
    if href.lower().startswith("javascript:"):
        return ""
    return href + "/" if re.fullmatch(r"(?i)https?://[^/?#]+", href) else href


def footnote_target(n: Node) -> str:
    """The number or name of the note that a link refers to, or nothing."""
    m = re.match(r"#(?:fn:|fn-|fn(?=\d)|footnote-|cite_note-)(.*)", n.attrs.get("href", ""))
    if m:
        return m[1].split("-")[0]
    m = re.fullmatch(r"#(\d+)", n.attrs.get("href", ""))
    return m[1] if m and n.text.strip() == m[1] else ""


def is_backref(n: Node) -> bool:
    href, cls = n.attrs.get("href", ""), n.attrs.get("class", "")
    return "#fnref" in href or "#cite_ref" in href or "backref" in cls or "footnote-back" in n.attrs.get("rel", "").split()


def table_kind(t: Node) -> str:
    rows = [[c for c in r.children if c.tag in ("td", "th")] for r in t.all("tr")]
    cells = [c for r in rows for c in r]
    if not rows:
        return "empty"
    if any(c.attrs.get(a, "").isdigit() and int(c.attrs[a]) > 1 for c in cells for a in ("colspan", "rowspan")):
        return "complex"
    if max(map(len, rows)) <= 1 and not any(c.all("table") for c in cells):
        return "layout"
    return "simple" if any(c.text.strip() for c in cells) else "empty"


def image_source(n: Node) -> str:
    picture = n.parent if n.parent is not None and n.parent.tag == "picture" else None
    sets = [s.attrs.get("srcset", "") for s in picture.all("source")] if picture else []
    best = next((b for s in (*sets, n.attrs.get("srcset", "")) if s and (b := best_of_srcset(s))), "")
    src = n.attrs.get("src", "")
    return best or ("" if src.startswith("data:") else src) or n.attrs.get("data-src", "")


# The writer goes down a tree by calls, some five for each of the levels that a parsed page can have.
sys.setrecursionlimit(max(sys.getrecursionlimit(), 20 * DEEPEST))


class Writer:
    """Blocks are lists of lines of text that the caller joins with blank lines."""

    def __init__(self, base: str | None = None):
        self.base, self.notes, self.in_table = base, [], False

    # inline

    def inline(self, n: Node) -> str:
        return "".join(map(self.span, n.children))

    def span(self, n: Node) -> str:
        if n.tag == "#text":
            return inline_text(n.data)
        if not n.element or n.tag in SKIPPED:
            return ""
        if n.tag == "br":
            return "  \n"
        if n.tag in SURROUND:
            inner = self.inline(n).strip()
            return f"{SURROUND[n.tag]}{inner}{SURROUND[n.tag]}" if inner else ""
        special = getattr(self, "span_" + n.tag, None)
        if special:
            return special(n)
        if {"math", "katex", "katex-display"} & set(n.classes) and (n.attrs.get("data-latex") or n.all("annotation")):
            return self.formula(latex_of(n), bool({"katex-display", "math-display"} & set(n.classes)))
        return self.inline(n)

    def formula(self, latex: str, block: bool) -> str:
        return f"\n\n$$\n{latex}\n$$\n\n" if block and not self.in_table else f"${latex}$" if latex else ""

    def span_math(self, n: Node) -> str:
        return self.formula(latex_of(n), n.attrs.get("display") == "block")

    def span_iframe(self, n: Node) -> str:
        return serialize(n)

    def span_sub(self, n: Node) -> str:
        inner = self.inline(n).strip()
        return f"<sub>{inner}</sub>" if inner else ""

    def span_sup(self, n: Node) -> str:
        own = re.match(r"(?:fnref:?|footnote-ref-|cite_ref-)(.*)", n.attrs.get("id", ""))
        target = own[1].split("-")[0] if own else next((t for a in n.all("a") if (t := footnote_target(a))), "")
        said = n.text.strip()
        if target or re.fullmatch(r"\d{1,4}", said):
            return f"[^{target or said}]"
        inner = self.inline(n).strip()
        return f"<sup>{inner}</sup>" if inner else ""

    def span_code(self, n: Node) -> str:
        said = n.text.strip()
        ticks = "`" * (max(map(len, re.findall("`+", said)), default=0) + 1)
        return f"{ticks}{' ' * said.startswith('`')}{said}{' ' * said.endswith('`')}{ticks}" if said else ""

    def span_img(self, n: Node) -> str:
        src = image_source(n)
        if not src or src.startswith("data:"):
            return ""
        alt = re.sub(r"\s+", " ", n.attrs.get("alt", "")).strip()
        title = n.attrs.get("title", "")
        return f"![{alt}]({self.resolved(src)}" + (' "{}"'.format(title.replace('"', '\\"')) if title else "") + ")"

    def span_a(self, n: Node) -> str:
        target = footnote_target(n)
        if target and (n.all("sup") or not is_backref(n) and re.fullmatch(r"[\d↩]*", n.text.strip())):
            return f"[^{target}]"
        if is_backref(n):
            return ""
        inner, href = self.inline(n).strip(), href_of(n)
        if not inner or not href:
            return inner
        title = n.attrs.get("title", "")
        return f"[{inner}]({self.resolved(href)}" + (' "{}"'.format(title.replace('"', '\\"')) if title else "") + ")"

    def resolved(self, href: str) -> str:
        if not self.base or re.match(r"[a-zA-Z][\w+.-]*:|#", href):
            return href
        try:
            return urljoin(self.base, href)
        except ValueError:
            return href

    # blocks

    def blocks(self, parent: Node) -> list[str]:
        return [b for n in parent.children for b in self.block(n) if b.strip()]

    def block(self, n: Node) -> list[str]:
        if n.tag == "#text":
            return [inline_text(n.data).strip()] if n.data.strip() else []
        if not n.element or n.tag in SKIPPED or n.tag == "br":
            return []
        if n.tag in HEADINGS:
            said = self.inline(n).strip()
            return [f"{'#' * max(2, int(n.tag[1]))} {said}"] if said else []
        special = getattr(self, "block_" + n.tag, None)
        if special:
            return special(n)
        if n.tag in ("p", "li", "figcaption", "details") or n.tag in AS_BLOCK:
            return [(self.span(n) if n.tag in AS_BLOCK else self.inline(n)).strip()]
        if n.tag in ("div", "blockquote") and ("data-callout" in n.attrs or "callout" in n.classes):
            return self.callout(n)
        if "footnote-definition" in n.classes:
            kept = [c for c in n.children if "footnote-definition-label" not in c.classes]
            self.note(n.attrs.get("id", "").split("-")[0], " ".join(b for c in kept for b in self.block(c)))
            return []
        return self.blocks(n)

    def note(self, name: str, said: str) -> None:
        said = " ".join(x for line in said.split("\n") if (x := line.strip()))
        if name:
            self.notes.append((name, re.sub(r"\s*↩\ufe0e?\s*\Z", "", said)))

    def quoted(self, blocks: list[str]) -> list[str]:
        return [f"> {line}" if line else ">" for line in "\n\n".join(blocks).split("\n")] if blocks else []

    def block_hr(self, n: Node) -> list[str]:
        return ["---"]

    def block_blockquote(self, n: Node) -> list[str]:
        if "data-callout" in n.attrs or "callout" in n.classes:
            return self.callout(n)
        lines = self.quoted(self.blocks(n))
        return ["\n".join(lines)] if lines else []

    def callout(self, n: Node) -> list[str]:
        kind = n.attrs.get("data-callout") or next((c[8:] for c in n.classes if c.startswith("callout-")), "")
        fold = n.attrs.get("data-callout-fold", "")
        title, content = n.first(".callout-title-inner"), n.first(".callout-content")
        said = (self.inline(title).strip() if title is not None else "") or kind[:1].upper() + kind[1:]
        head = f"> [!{kind}]{fold if fold in ('+', '-') else ''}" + (f" {said}" if said else "")
        return ["\n".join([head, *self.quoted(self.blocks(content) if content is not None else [])])]

    def block_ul(self, n: Node, depth: int = 0) -> list[str]:
        lines = self.items(n, depth)
        return ["\n".join(lines)] if lines else []

    def block_ol(self, n: Node) -> list[str]:
        around = [n, *n.up()]
        if "footnotes-list" in n.classes or any(a.attrs.get("id", "").lower() == "footnotes" or {"footnotes", "footnote"} & set(a.classes) or a.tag == "aside" for a in around[1:]):
            for i, li in enumerate((c for c in n.children if c.tag == "li"), 1):
                own = re.sub(r"\A(?:user-content-)?(?:fn[:-]?|footnote-|cite_note-)", "", li.attrs.get("id", "")).split("-")[0]
                self.note(own or str(i), " ".join(self.blocks(li)) if li.all("p", "div", "ul", "ol") else self.inline(li).strip())
            return []
        return self.block_ul(n)

    def items(self, n: Node, depth: int) -> list[str]:
        start = n.attrs.get("start", "")
        number, lines = int(start) if start.isdigit() else 1, []
        for li in (c for c in n.children if c.tag == "li"):
            said, below = "", []
            for c in li.children:
                if c.tag in ("ul", "ol"):
                    below += self.items(c, depth + 1)
                elif c.tag == "p":
                    inner = self.inline(c).strip()
                    if said.strip():
                        below += ["", "\t" * (depth + 1) + inner]
                    else:
                        said = inner
                elif c.tag in ("#text", "br") or c.tag in INLINE_IN_ITEM:
                    said += self.span(c)
                elif c.element:
                    below += ["\t" * (depth + 1) + line if line else "" for b in self.block(c) for line in b.split("\n")]
            box = next((i for i in li.all("input") if i.attrs.get("type", "").lower() == "checkbox"), None)
            mark = "" if box is None else "[x] " if "checked" in box.attrs or box.attrs.get("data-checked", "false") != "false" else "[ ] "
            if said.strip() or below:
                lines += ["\t" * depth + (f"{number}. " if n.tag == "ol" else "- ") + mark + said.strip(), *below]
            number += 1
        return lines

    def block_pre(self, n: Node) -> list[str]:
        language, body = language_of(n), code_text(n)
        return [f"```{language}\n{body}\n```"] if body.strip() or language else []

    def block_code(self, n: Node) -> list[str]:
        return self.blocks(n) if n.all("pre") else [self.span(n)]

    def block_table(self, n: Node) -> list[str]:
        kind = table_kind(n)
        if kind == "layout":
            return [b for r in n.all("tr") for c in r.children if c.tag in ("td", "th") for b in self.blocks(c)]
        if kind == "complex":
            return [serialize(n)]
        if kind == "empty":
            return []
        sub = Writer(self.base)
        sub.in_table = True
        rows = [([cell_text(sub.inline(c)) for c in r.children if c.tag in ("td", "th")], any(c.tag == "th" for c in r.children)) for r in n.all("tr")]
        width = max(len(r) for r, _ in rows)
        padded = [r + [""] * (width - len(r)) for r, _ in rows if r]
        at = next((i for i, (r, th) in enumerate((r, t) for r, t in rows if r) if th), 0)
        head, rest = padded[at], padded[:at] + padded[at + 1 :]
        return ["\n".join("| " + " | ".join(r) + " |" for r in (head, ["---"] * width, *rest))]

    def block_figure(self, n: Node) -> list[str]:
        img, caption = n.first("img"), n.first("figcaption")
        if img is None or any(not p.inside("figcaption") for p in n.all("p")):
            return self.blocks(n)
        return [b for b in (self.span_img(img), self.inline(caption).strip() if caption is not None else "") if b]

    def block_dl(self, n: Node) -> list[str]:
        return [self.inline(c).strip() for c in n.elements if c.tag in ("dt", "dd")]

    def block_img(self, n: Node) -> list[str]:
        return [self.span_img(n)]

    def block_iframe(self, n: Node) -> list[str]:
        return [serialize(n).strip()]

    block_video = block_audio = block_iframe

    def block_math(self, n: Node) -> list[str]:
        latex = latex_of(n)
        return [f"$$\n{latex}\n$$"] if latex else []


def is_title(heading: str, title: str) -> bool:
    said = re.sub(r"\\([\\`\[\]_*])", r"\1", heading).strip().lower()
    title = title.strip().lower()
    return said == title or bool(said) and title.startswith(said) and title[len(said) :].lstrip()[:1] in ("-", "|", "·", ":") and title != said


def finished(blocks: list[str], notes: list[tuple[str, str]], title: str) -> str:
    if title and blocks and (m := re.fullmatch(r"##? (.*)", blocks[0])) and is_title(m[1], title):
        blocks = blocks[1:]
    md = "\n\n".join(b.strip("\n") for b in blocks)
    md = re.sub(r"(?m)(^|[^!])\[\]\([^)]*\)", r"\1", md)
    md = re.sub(r"!(!\[|\[!\[)", r"! \1", md)
    md = re.sub(r"\n{3,}", "\n\n", md)
    if notes:
        md += "\n\n" + "\n\n".join(f"[^{name}]: {said}" for name, said in notes)
    lines = (line if len(line) - len(line.rstrip(" ")) == 2 else line.rstrip() for line in md.split("\n"))
    return "\n".join(lines).strip()


def node_to_markdown(node: Node, title: str = "", base: str | None = None) -> str:
    writer = Writer(base)
    return finished(writer.blocks(body_of(node)), writer.notes, title)


def html_to_markdown(html: str, title: str = "", base: str | None = None) -> str:
    return node_to_markdown(parse(re.sub(r"(?i)</?wbr[^>]*>", "", html)), title, base)
