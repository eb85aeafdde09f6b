"""Rewriting of content to a common shape: wrappers, code, callouts, math, images, footnotes, tables, headings, links."""

from __future__ import annotations

import re
from urllib.parse import parse_qs, unquote_plus, urljoin, urlsplit

from pagequern.html.dom import HEADINGS, Node, fragment, inner_html, text_node

# Names by which pages mark the parts that are rewritten here.
KEEP_DIV = ("article", "content", "footnote", "reference", "bibliography", "callout")
SEMANTIC = ("article", "content", "footnote", "reference", "bibliography", "callout", "admonition", "note", "highlight", "language-", "math", "katex", "mathjax", "footnotes")
BLOCKS = frozenset((*HEADINGS, *"div section article aside header footer nav main p pre blockquote table ul ol dl figure form fieldset details summary hr".split()))
ADMONITIONS = ("info", "warning", "note", "tip", "danger", "caution", "important", "abstract", "success", "question", "failure", "bug", "example", "quote")
ALERT = re.compile(r"(?i)\A\s*\[!(NOTE|TIP|IMPORTANT|WARNING|CAUTION|DANGER)\]([+-]?)[ \t]*\n?")
_BOX = re.compile("callout|alert|admonition")
GUTTER = frozenset("lineno linenos linenumber line-number line-numbers gutter hljs-ln-numbers blob-num rouge-gutter cm-gutters ln lnt react-syntax-highlighter-line-number".split())
CODE_CHROME = frozenset("copy copy-button copy-btn btn-copy clipboard code-header code-toolbar toolbar toolbar-item code-block-header hljs-copy-button lang-label code-lang".split())
NOT_SELECTED = re.compile(r"(?i)user-select\s*:\s*none")
NO_LANGUAGE = frozenset(("none", "plaintext", "text", ""))
PERMALINKS = frozenset(("#", "¶", "§", "🔗", "", "link"))
LAZY_SRC = ("data-src", "data-original", "data-lazy-src", "data-lazy")
RAW_MATH = re.compile(r"\$\$(.+?)\$\$|\\\[(.+?)\\\]|\\\((.+?)\\\)|(?<![\\$\w])\$([^$\n]+?)\$(?![\w$])", re.S)
PLACEHOLDER = 200


def capitalized(s: str) -> str:
    return s[:1].upper() + s[1:]


def has_class(n: Node, *names: str) -> bool:
    return any(c in n.classes for c in names)


# Text of the page


def spaces(html: str) -> str:
    """Outside of code: one space for several, trimmed lines, one blank line at most."""
    parts = re.split(r"(?is)(<pre\b.*?</pre>)", html)
    for i in range(0, len(parts), 2):
        lines = [re.sub(r" {2,}", " ", line).strip() for line in parts[i].split("\n")]
        parts[i] = re.sub(r"\n{3,}", "\n\n", "\n".join(lines))
    return "".join(parts).strip()


def embeds(html: str) -> str:
    """Links in place of embedded videos and posts."""
    html = re.sub(
        r"""(?is)<iframe[^>]*src=["'](?:https?:)?//(?:www\.)?(?:youtube(?:-nocookie)?\.com/embed/|youtu\.be/)([\w-]+)[^"']*["'][^>]*>.*?</iframe>""",
        r'<a href="https://www.youtube.com/watch?v=\1">YouTube: \1</a>', html,
    )
    return re.sub(
        r"""(?is)<iframe[^>]*src=["']https?://(?:www\.)?(?:twitter|x)\.com/(\w+)/status/(\d+)[^"']*["'][^>]*>.*?</iframe>""",
        r'<a href="https://twitter.com/\1/status/\2">Tweet by @\1: \2</a>', html,
    )


def noscript_images(html: str) -> str:
    """The images of noscript elements in their place."""
    return re.sub(r"(?is)<noscript[^>]*>(.*?)</noscript>", lambda m: "".join(re.findall(r"(?is)<img\b[^>]*>", m[1])) or m[0], html)


def plain_wrappers(html: str, debug: bool) -> str:
    """Comments go, embeds become links; unless debugging, empty blocks go and divs without meaning are unwrapped."""
    html = embeds(re.sub(r"<!--.*?-->", "", spaces(html)))
    if debug:
        return html
    html = re.sub(r"<div[^>]*>\s*</div>", "", re.sub(r"<p[^>]*>\s*</p>", "", html))
    top = Node("#document", children=fragment(html))
    for n in top.all("div")[::-1]:
        named = n.attrs.get("class", "").lower()
        tokens = named.split()
        marked = any(a in n.attrs for a in ("role", "aria-label", "aria-hidden", "hidden", "itemscope")) or any(a.startswith(("data-callout", "data-rehype", "data-floating", "data-fade")) for a in n.attrs)
        code = any(t.startswith(("language-", "lang-", "highlight-source")) or t in ("highlight", "highlighter-rouge", "expressive-code", "code-block") for t in tokens)
        if not marked and not code and not any(k in named for k in KEEP_DIV) and not n.inside("pre"):
            n.unwrap()

    return spaces(inner_html(top))


# Callouts


def callout(kind: str, title: str, source: Node, fold: str = "") -> Node:
    attrs = {"class": "callout", "data-callout": kind} | ({"data-callout-fold": fold} if fold else {})
    head = Node("div", {"class": "callout-title"}, children=[Node("div", {"class": "callout-title-inner"}, children=[text_node(title)])])
    return Node("div", attrs, children=[head, Node("div", {"class": "callout-content"}, children=list(source.children))])


def callouts(root: Node) -> None:
    """The alert boxes of several systems as one kind of callout."""
    if not any(n.tag == "blockquote" or "data-callout" in n.attrs or _BOX.search(n.attrs.get("class", "")) for n in root.all()):
        return
    for n in root.select("[data-callout]"):
        for inner in n.select(".callout-content"):
            inner.attrs.pop("style", None)
        if "is-collapsed" in n.classes:
            n.attrs.setdefault("data-callout-fold", "-")
    for n in root.select("[class*=markdown-alert-]"):
        kind = next((c[15:] for c in n.classes if c.startswith("markdown-alert-") and c != "markdown-alert-title"), None)
        if kind and n.tag != "p":
            for t in n.select(".markdown-alert-title"):
                t.detach()
            n.replace(callout(kind, capitalized(kind), n))
    for n in root.all("blockquote"):
        first = next((t for t in n.walk() if t.tag == "#text" and t.data.strip()), None)
        if first is not None and (m := ALERT.match(first.data)):
            first.data = first.data[m.end() :]
            if not first.data and (line := first.parent.next_element() if first.parent.tag != "p" else None) is not None and line.tag == "br":
                line.detach()
            n.replace(callout(m[1].lower(), capitalized(m[1].lower()), n, m[2]))
    for n in root.select("aside[class*=callout]"):
        kind = next((c[8:].lower() for c in n.classes if c.startswith("callout-")), None)
        if kind and "data-callout" not in n.attrs:
            n.replace(callout(kind, capitalized(kind), n.first(".callout-content") or n))
    for name, prefix, titles, bodies in (("admonition", "admonition-", ".admonition-title", (".admonition-content", ".details-content")), ("alert", "alert-", ".alert-heading, .alert-title", ())):
        for n in root.select("." + name):
            own = [c.removeprefix(prefix) for c in n.classes if c.startswith(prefix) and c != "alert-dismissible"]
            kind = next((c for c in (*n.classes, *own) if c in ADMONITIONS), "note") if name == "admonition" else own[0].lower() if own else None
            if kind is None or "data-callout" in n.attrs:
                continue
            title = n.first(titles)
            said = title.text.strip() if title is not None else ""
            if title is not None:
                title.detach()
            n.replace(callout(kind, said or capitalized(kind), next((b for s in bodies if (b := n.first(s)) is not None), n)))


# Code


def language_of(n: Node) -> str:
    """The language that a code element, what is in it or what is around it names."""
    around = []
    for a in n.up():
        if a.tag in ("body", "article", "main", "#document") or len(around) == 6:
            break
        around.append(a)
    for e in (n, *n.all("code"), *n.all()[:40], *around):
        for key in ("data-language", "data-lang"):
            if e.attrs.get(key, "").lower() not in NO_LANGUAGE:
                return e.attrs[key].lower()
        for c in e.classes:
            m = re.fullmatch(r"(?:language-|lang-|highlight-source-|brush:)([\w+#.-]+)", c)
            if m and m[1].lower() not in NO_LANGUAGE:
                return m[1].lower()
        if {"highlight", "hljs", "sourceCode"} & set(e.classes):
            other = [c for c in e.classes if c not in ("highlight", "hljs", "sourceCode", "code") and re.fullmatch(r"[a-z][a-z0-9+#]{0,15}", c) and c not in ("block", "chroma", "table")]
            if other and other[0] not in NO_LANGUAGE:
                return other[0]
    return ""


def code_text(n: Node) -> str:
    """The lines of a code block without gutters, buttons and labels."""
    out: list[str] = []
    ended = False  # a line element has just ended: the line break after it in the source is the same one

    def visit(e: Node) -> None:
        nonlocal ended
        if e.tag == "#text":
            said = e.data[1:] if ended and e.data.startswith("\n") else e.data
            ended = ended and not e.data
            if said:
                out.append(said)
            return
        names = {c.lower() for c in e.classes}
        if e.tag in ("button", "style", "script") or NOT_SELECTED.search(e.attrs.get("style", "")) and re.fullmatch(r"\s*\d+\s*", e.text) or names & GUTTER or names & CODE_CHROME or "data-line-number" in e.attrs and not e.text.strip():
            return
        if e.tag == "br":
            if not ended:
                out.append("\n")
            ended = False
            return
        line = e is not n and (bool(names & {"line", "code-line", "cl", "view-line", "cm-line", "ec-line", "token-line"}) or "data-line" in e.attrs or e.tag in ("div", "tr", "li", "p"))
        if line and out and not out[-1].endswith("\n"):
            out.append("\n")
        ended, begin = False if line else ended, len(out)
        for c in e.children:
            visit(c)
        if line:
            if len(out) == begin or not out[-1].endswith("\n"):
                out.append("\n")
            ended = True

    visit(n)
    lines = [line.rstrip() for line in "".join(out).replace("\xa0", " ").replace("\t", "    ").split("\n")]
    while lines and not lines[0]:
        lines.pop(0)
    while lines and not lines[-1]:
        lines.pop()
    indent = min((len(line) - len(line.lstrip()) for line in lines if line), default=0)
    return re.sub(r"\n{3,}", "\n\n", "\n".join(line[indent:] for line in lines))


def code_blocks(root: Node) -> None:
    """Highlighted code as pre and code with a language class."""
    for n in root.select("figure.highlight, table.lntable, div.highlight, div.codehilite, .cm-editor, .CodeMirror, pre"):
        if n.parent is None or n.inside("pre") or n.tag == "figure" and n.all("img"):
            continue
        cell = n.first("td.code, td.rouge-code")
        inner = cell or next((c for c in n.all("td")[::-1] if c.all("pre", "code")), n)
        if n.tag != "pre" and not n.all("pre", "code") and not has_class(n, "cm-editor", "CodeMirror", "highlight"):
            continue
        language, text = language_of(n), code_text(inner)
        if text or n.tag == "pre":
            code = Node("code", {"class": f"language-{language}", "data-lang": language} if language else {}, children=[text_node(text)])
            n.replace(Node("pre", children=[code]))


# Math


def math_node(latex: str, block: bool) -> Node:
    return Node("math", {"xmlns": "http://www.w3.org/1998/Math/MathML", "display": "block" if block else "inline", "data-latex": latex.strip(), "alttext": latex.strip()}, children=[text_node(latex.strip())])


def math_of_image(src: str) -> str | None:
    """The formula in the address of a rendering service."""
    parts = urlsplit(src)
    query = parse_qs(parts.query, keep_blank_values=True)
    for key in ("latex", "chl", "tex", "eq", "math"):
        if key in query:
            return query[key][0]
    found = [unquote_plus(x) for x in (parts.query, *parts.path.split("/")) if "%5C" in x.upper() or "\\" in x]
    return found[0] if found else None


def math(root: Node) -> None:
    """Formulas of all sources as math elements that carry their LaTeX."""
    rendered = root.select("math, .katex, .MathJax, [data-math], [data-latex], mjx-container")
    if not rendered:
        for t in [t for t in root.walk() if t.tag == "#text" and ("$" in t.data or "\\(" in t.data or "\\[" in t.data)]:
            if t.inside("pre", "code", "script", "style", "textarea", "math"):
                continue
            parts, at = [], 0
            for m in RAW_MATH.finditer(t.data):
                if m[4] is not None and not re.search(r"\\[a-zA-Z]|[_^{}]", m[4]):
                    continue
                alone = not (t.data[: m.start()].strip() or t.data[m.end() :].strip()) and len(t.parent.elements) == 0
                parts += [text_node(t.data[at : m.start()]), math_node(next(g for g in m.groups() if g is not None), (m[1] or m[2]) is not None and alone)]
                at = m.end()
            if parts:
                t.replace(*parts, text_node(t.data[at:]))
    for n in root.all("img"):
        alt = n.attrs.get("alt", "")
        wiki = any("mwe-math" in c for a in (n, *list(n.up())[:3]) for c in a.classes)
        latex = alt if re.search(r"\\[a-zA-Z]{2}", alt) or "_" in alt and "^" in alt else math_of_image(n.attrs.get("src", "")) if re.search(r"latex|chart\.googleapis|codecogs|/math/", n.attrs.get("src", "")) else None
        if latex and not wiki:
            n.replace(math_node(latex, has_class(n, "block", "display", "equation")))
    for n in root.select("[data-math]"):
        if n.tag != "math":
            n.replace(math_node(n.attrs["data-math"], n.tag == "div" or has_class(n, "display", "math-display", "block")))
    for n in root.all("math"):
        tex = next((a for a in n.all("annotation") if "tex" in a.attrs.get("encoding", "").lower()), None)
        if tex is not None and "data-latex" not in n.attrs:
            n.attrs["data-latex"] = n.attrs["alttext"] = tex.text.strip()
    for n in root.select(".katex"):
        tex = next((a for a in n.all("annotation") if "tex" in a.attrs.get("encoding", "").lower()), None)
        if tex is not None:
            n.replace(math_node(tex.text, any(has_class(a, "katex-display", "math-display") for a in n.up())))


# Images


def srcset_entries(srcset: str) -> list[tuple[str, float]]:
    """(address, weight) of the entries: width, or 1000 for each unit of density."""
    found = []
    for part in re.split(r"(?<=[\dwx])\s*,\s+|(?<=\s[\dwx.])\s*,|,\s+(?=\S)", srcset.strip()):
        words = part.strip().rstrip(",").split()
        if words:
            m = re.fullmatch(r"([\d.]+)([wx])", words[1]) if len(words) > 1 else None
            found.append((words[0], (float(m[1]) * (1000 if m[2] == "x" else 1)) if m else 0.0))
    return found


def best_of_srcset(srcset: str) -> str | None:
    entries = srcset_entries(srcset)
    return max(entries, key=lambda e: e[1])[0] if entries else None


def images(root: Node) -> None:
    """Lazy sources become sources, pictures their image; tracking pixels go."""
    for n in root.all("noscript"):
        found = [c for t in n.walk() if t.tag == "#text" for c in fragment(t.data) if c.tag == "img"] or n.all("img")
        before = n.previous_element()
        if found:
            if before is not None and before.tag == "img" and before.attrs.get("src", "").startswith(("data:", "")) and not before.attrs.get("src", "").startswith("http"):
                before.detach()
            n.replace(*found)
    for p in root.all("picture"):
        img = p.first("img")
        source = next((s.attrs["srcset"] for s in p.all("source") if s.attrs.get("srcset")), "")
        if img is None and source:
            img = Node("img")
        if img is not None:
            if source and (not img.attrs.get("src") or img.attrs["src"].startswith("data:")):
                img.attrs["src"] = srcset_entries(source)[0][0]
            p.replace(img)
    for n in root.all("img"):
        a = n.attrs
        lazy = next((a[k] for k in LAZY_SRC if a.get(k)), None)
        src = a.get("src", "")
        if lazy and (not src or src.startswith("data:") and len(src) <= PLACEHOLDER + 100):
            a["src"] = lazy
        if a.get("data-srcset") and not a.get("srcset"):
            a["srcset"] = a["data-srcset"]
        for k in (*LAZY_SRC, "data-srcset", "loading"):
            a.pop(k, None)
        if (not a.get("src") or a["src"].startswith("data:")) and a.get("srcset") and (best := best_of_srcset(a["srcset"])):
            a["src"] = best
        if a.get("width") == "1" and a.get("height") == "1" or any(x in a.get("src", "") for x in ("/pixel.", "tracking", "/1x1.")):
            n.detach()


# Headings, wrappers, semantics, tables, links


def headings(root: Node) -> None:
    """No permalinks, numbers and buttons in headings; one h1; no repeated heading and none at the end."""
    for h in root.all(*HEADINGS):
        for a in h.all("a"):
            said = a.text.strip()
            marked = re.search(r"anchor|permalink|headerlink|hash-link", a.attrs.get("class", "").lower() + a.attrs.get("aria-label", "").lower() + a.attrs.get("title", "").lower())
            if (said in PERMALINKS or marked and len(said) < 3) and not a.all("img", "svg", "video", "picture"):
                a.detach()
        for n in h.select("button, .section-number, .header-section-number"):
            n.detach()
    for h in root.all(*HEADINGS):
        after = h.next_element()
        if after is not None and after.tag in HEADINGS and " ".join(after.text.split()).lower() == " ".join(h.text.split()).lower() != "":
            after.detach()
    for h in root.all("h1")[1:]:
        h.tag = "h2"
    for scope in root.all("body"):
        while (last := scope.elements[-1:]) and last[0].tag in HEADINGS and len(last[0].text.split()) <= 12:
            last[0].detach()


def is_wrapper(n: Node) -> bool:
    named = n.attrs.get("class", "").lower()
    if any(a in n.attrs for a in ("role", "aria-label", "itemscope", "data-mathml")) or any(a.startswith("data-callout") for a in n.attrs) or any(h in named for h in SEMANTIC):
        return False
    below = n.elements
    if len(below) == 1:
        return True
    return len(below) > 1 and not any(c.tag == "#text" and c.data.strip() for c in n.children) and all(c.tag in BLOCKS for c in below)


def flatten(root: Node) -> None:
    for _ in range(6):
        found = [n for n in root.all("div", "section", "main")[::-1] if is_wrapper(n)]
        for n in found:
            if n.parent is not None and n.parent.tag != "#document":
                n.unwrap()
        if not found:
            break


def semantics(root: Node) -> None:
    for n in root.select("[data-as]"):
        if re.fullmatch(r"[a-z][a-z0-9]*", n.attrs["data-as"]):
            n.tag = n.attrs.pop("data-as")
    for n in root.all("a"):
        if n.inside("code") or n.attrs.get("href", "").strip().lower().startswith("javascript:"):
            n.unwrap()
        elif len(n.elements) == 1 and n.elements[0].tag in HEADINGS and not any(c.tag == "#text" and c.data.strip() for c in n.children):
            h = n.elements[0]
            link = Node("a", dict(n.attrs), children=list(h.children))
            h.append(link)
            n.replace(h)
    for n in root.all("span")[::-1]:
        if not n.attrs and n.parent is not None and not n.inside("pre", "code"):
            n.unwrap()


def absolute_links(root: Node, base: str | None) -> None:
    for n in root.all() if base else ():
        key = "href" if n.tag in ("a", "link") else "src" if n.tag in ("img", "video", "audio", "source", "iframe", "script") else ""
        value = n.attrs.get(key, "").strip()
        if value and not value.startswith(("#", "data:", "javascript:", "mailto:", "tel:")):
            try:
                n.attrs[key] = urljoin(base, value)
            except ValueError:
                pass


def tables(root: Node) -> None:
    for t in root.all("table")[::-1]:
        if t.parent is None:
            continue
        cells, rows = t.all("td", "th"), t.all("tr")
        if not t.text.strip() and not t.all("img", "svg", "video", "iframe", "math", "picture"):
            t.detach()
        elif len(cells) == 1 or len(rows) == 1 and not t.all("th"):
            t.replace(*[c for cell in cells for c in list(cell.children)])
        else:
            for part in t.all("tbody", "thead", "tfoot"):
                if not part.elements:
                    part.detach()


# Footnotes

# How pages name and mark notes.
NOTE_NUMBER = re.compile(r"[\[(]?(\d{1,4})[\])]?[.:]?")
NOTE_HEADINGS = frozenset(("notes", "footnotes", "footnote", "endnotes", "references"))
NOTE_PARAGRAPHS = ("footnote", "footnote-text", "footnote-item")
NOTE_IDS = (
    (re.compile(r"\A(#?)_?ftnref(\d+)\Z"), r"\1fnref:\2"), (re.compile(r"\A(#?)ftnt_ref(\d+)\Z"), r"\1fnref:\2"),
    (re.compile(r"\A(#?)_?ftnt?(\d+)\Z"), r"\1fn:\2"), (re.compile(r"\A(#?)easy-footnote-bottom-(\d+)(?:-\d+)?\Z"), r"\1fn:\2"),
)
Note = tuple[str, list[Node]]


def canonical_note_ids(root: Node) -> None:
    """Word's, Google Docs' and a plugin's names of notes as fn:N and fnref:N."""
    for n in root.all():
        for key in ("id", "name", "href"):
            value = n.attrs.get(key, "")
            if "ftn" in value or "easy-footnote" in value:
                for pattern, new in NOTE_IDS:
                    n.attrs[key] = value = pattern.sub(new, value)
    for n in root.select("a.easy-footnote-to-top"):
        n.detach()


def reference(number: str) -> Node:
    return Node("sup", {"id": f"fnref:{number}"}, children=[Node("a", {"href": f"#fn:{number}"}, children=[text_node(number)])])


def inline_notes(root: Node) -> list[Note]:
    """Notes that stand in the text itself, or in an element that the reference names; references take their place."""
    notes: list[Note] = []
    for n in root.select("span.inline-footnote, span.footnote-inline, [data-definition]"):
        wanted = n.attrs.get("data-definition")
        own = re.fullmatch(r"\s*(\d+)\s*", "".join(c.data for c in n.children if c.tag == "#text"))
        number = own[1] if own else str(len(notes) + 1)
        if wanted is None:
            body = n.first(".footnoteContent, .footnote-content, .inline-footnote-content") or (n if has_class(n, "footnote-inline") else None)
        else:
            body = next((a for a in root.all("aside", "div", "span") if a.attrs.get("id") == wanted), None) if re.fullmatch(r"[A-Za-z_][\w-]*", wanted) else None
        if body is None:
            continue
        if body is not n:
            body.detach()
        notes.append((number, list(body.children)))
        n.replace(reference(number))
    return notes


def leading_number(p: Node) -> tuple[str, Node] | None:
    """The number that a paragraph begins with in sup or bold, perhaps within spans, and the node that holds it."""
    at: Node | None = p
    while at is not None and at.tag not in ("sup", "strong", "b"):
        if at is not p and at.tag != "span":
            return None
        at = next((c for c in at.children if c.element or c.tag == "#text" and c.data.strip()), None)
    if at is None:
        return None
    inner = next((c for c in at.children if c.element or c.data.strip()), None)
    for holder in (at, inner) if inner is not None and inner.tag == "sup" and at.tag != "sup" else (at,):
        if found := NOTE_NUMBER.fullmatch(holder.text.strip()):
            return found[1], holder
    return None


def heads_notes(n: Node | None) -> bool:
    return n is not None and (n.tag == "hr" or n.tag in HEADINGS and n.text.strip().lower() in NOTE_HEADINGS)


def taken_out(found: list[tuple[str, Node, Node | None]], run: bool = False) -> list[Note]:
    """Notes of (number, block, marker): blocks and markers leave the page, and a rule or heading before the first of them.

    In a run, what stands between two notes belongs to the first of them, and what follows the last
    one to that if a rule or heading sets the notes apart.
    """
    notes: list[Note] = []
    apart = bool(found) and heads_notes(before := found[0][1].previous_element())
    if apart:
        before.detach()
    blocks = {id(block) for _, block, _ in found}
    for i, (number, block, marker) in enumerate(found):
        if marker is not None:
            marker.detach()
        around, more = block.parent, []
        if run and (apart or i + 1 < len(found)):
            for after in around.children[block.place + 1 :]:
                if id(after) in blocks:
                    break
                more.append(after)
        for after in more:
            after.detach()
        block.detach()
        if any(m.element for m in more):
            notes.append((number, [Node("p", children=list(block.children)), *more]))
            continue
        while around is not None and around.parent is not None and around.tag in ("div", "section", "aside") and all(heads_notes(c) if c.element else not c.data.strip() for c in around.children):
            around.detach()
            around = None
        notes.append((number, list(block.children)))
    return notes


def paragraph_notes(root: Node) -> list[Note]:
    """Paragraphs that are notes: by their id, by a link back, by their class, or as a run that begins with rising numbers."""
    marked: list[tuple[str, Node, Node | None]] = [(m[1], p, None) for p in root.all("p") if (m := re.fullmatch(r"fn:?-?(\d+)", p.attrs.get("id", "")))]
    for a in root.select("a[href^='#fnref']"):
        p = next((x for x in a.up() if x.tag in ("p", "div")), None)
        number = re.search(r"\d+", a.attrs["href"])
        if p is not None and number and all(p is not x for _, x, _ in marked) and not p.inside("li") and re.match(r"\s*\[?\d+", p.text):
            marked.append((number[0], p, a))
    if len(marked) == 1 and not heads_notes(marked[0][1].previous_element()):
        marked = []
    marked.sort(key=lambda m: int(m[0]))
    runs: dict[int, list[tuple[str, Node, Node | None]]] = {}
    notes: list[Note] = []
    for p in root.all("p"):
        if (found := leading_number(p)) and all(p is not x for _, x, _ in marked) and not p.inside("li", "blockquote", "td"):
            (marked if has_class(p, *NOTE_PARAGRAPHS) else runs.setdefault(id(p.parent), [])).append((found[0], p, found[1]))
    for run in runs.values():
        numbers = [int(number) for number, _, _ in run]
        if numbers == sorted(set(numbers)) and (len(run) > 1 or heads_notes(run[0][1].previous_element())):
            notes += taken_out(run, True)
    return taken_out(marked) + notes


def numbered_references(root: Node) -> list[Note]:
    """Blocks that begin with a number to which links with that number lead. The links become references."""
    named = {n.attrs[key]: n for n in root.all() for key in ("name", "id") if n.attrs.get(key)}
    order = {id(n): i for i, n in enumerate(root.all())}
    found: dict[str, tuple[str, Node, Node | None]] = {}
    links: list[tuple[Node, str]] = []
    for a in root.select("a[href^='#']"):
        number, target = NOTE_NUMBER.fullmatch(a.text.strip()), named.get(a.attrs["href"][1:])
        if not number or target is None or order[id(target)] < order[id(a)] or target.tag in ("li", "sup") or target.inside("li", "sup", "pre"):
            continue
        block = next((x for x in (target, *target.up()) if x.tag in ("p", "div")), None)
        marker = NOTE_NUMBER.fullmatch(target.text.strip()) if target is not block else None
        if block is not None and marker and marker[1] == number[1] and len(block.text.strip()) > len(target.text.strip()):
            found[number[1]] = (number[1], block, target)
            links.append((a, number[1]))
    if len(found) < 2:
        return []
    for a, number in links:
        a.replace(reference(number))
    return taken_out(list(found.values()))


def footnotes(root: Node) -> None:
    """The notes of all systems as an ordered list with fn: ids, and references in sup."""
    canonical_note_ids(root)
    notes = inline_notes(root) + paragraph_notes(root) + numbered_references(root)
    if notes:
        blocks = lambda c: any(x.tag in ("p", "div", "ul", "ol", "blockquote") for x in c)
        items = [Node("li", {"id": f"fn:{k}", "class": "footnote"}, children=c if blocks(c) else [Node("p", children=c)]) for k, c in notes]
        next(iter(root.all("body")), root).append(Node("div", {"id": "footnotes", "class": "footnotes"}, children=[Node("ol", {"class": "footnotes-list"}, children=items)]))
    for a in root.select("a[href^='#fn:'], a[href^='#fn-'], a[href^='#footnote-'], a[href^='#cite_note']"):
        if a.parent is not None and a.parent.tag not in ("sup", "li") and re.fullmatch(r"\[?[\d*†]+\]?", a.text.strip()):
            at = Node("sup")
            a.before(at)
            at.append(a)
    for ol in root.select("#footnotes ol, .footnotes ol, ol.references, ol.footnotes, ol.easy-footnotes-wrapper, [data-footnotes] ol"):
        if "footnotes-list" not in ol.classes:
            ol.attrs["class"] = " ".join([*ol.classes, "footnotes-list"])


def dom_passes(root: Node, base: str | None) -> None:
    """All rewriting of a tree, in order."""
    callouts(root)
    code_blocks(root)
    flatten(root)
    semantics(root)
    absolute_links(root, base)
    images(root)
    tables(root)
    callouts(root)
    math(root)
    headings(root)
    footnotes(root)
