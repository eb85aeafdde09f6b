"""A small HTML tree: parsing, serializing, walking and selecting, in plain Python.

The parser builds html, head and body around whatever it finds, closes what HTML lets a page leave
open (paragraphs, list items, cells, options), keeps the content of script-like elements as text,
and opens unclosed formatting elements again in the next block. Unlike the full standard it has no
foster parenting and no namespaces: a misplaced element stays where it is found. Nesting ends at
DEEPEST, as in browsers: what is deeper becomes a sibling there, so that no page is too deep to read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from html import escape, unescape

# Element classes of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TEXT = frozenset("script style xmp iframe noembed noframes".split())
ESCAPABLE = frozenset("title textarea".split())
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
HEAD_ONLY = frozenset("base link meta title style script noscript template".split())
ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr main menu nav ol p pre search section summary table ul".split()
)
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
            "tbody": {"tbody", "thead", "tfoot", "tr", "td", "th"}, "thead": {"tbody", "thead", "tfoot", "tr", "td", "th"}, "tfoot": {"tbody", "thead", "tr", "td", "th"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "option": {"select"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "tbody": {"table"}, "thead": {"table"}, "tfoot": {"table"}}
HOLDS_NO_TEXT = frozenset("ul ol menu dl table tbody thead tfoot tr select".split())
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
#: Open elements at most.
DEEPEST = 512

_TOKEN = re.compile(r"<!--(.*?)(?:--!?>|\Z)|<!(doctype[^>]*)>|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>", re.S | re.I)
_ATTR = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?""")


class Node:
    """An element, or with a tag that begins with # a text, comment, doctype or the document."""

    __slots__ = ("attrs", "children", "data", "parent", "tag")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None, data: str = "", children: list[Node] | None = None):
        self.tag, self.attrs, self.data, self.parent, self.children = tag, attrs or {}, data, None, []
        for c in children or ():
            self.append(c)

    def append(self, child: Node) -> Node:
        child.detach()
        child.parent = self
        self.children.append(child)
        return child

    def detach(self) -> None:
        if self.parent:
            self.parent.children.remove(self)
            self.parent = None

    @property
    def place(self) -> int:
        return next(i for i, c in enumerate(self.parent.children) if c is self)

    def replace(self, *others: Node) -> None:
        """Puts others where this node stands."""
        for other in others:
            other.detach()
        parent, at = self.parent, self.place
        for other in others:
            other.parent = parent
        self.parent = None
        parent.children[at : at + 1] = others

    def before(self, other: Node) -> None:
        other.detach()
        other.parent = self.parent
        self.parent.children.insert(self.place, other)

    def unwrap(self) -> None:
        parent, at, below = self.parent, self.place, self.children
        self.parent, self.children = None, []
        for c in below:
            c.parent = parent
        parent.children[at : at + 1] = below

    def copy(self) -> Node:
        """This node and all below, without a parent."""
        top = Node(self.tag, dict(self.attrs), self.data)
        stack = [(self, top)]
        while stack:
            node, to = stack.pop()
            for c in node.children:
                twin = Node(c.tag, dict(c.attrs) if c.attrs else None, c.data)
                twin.parent = to
                to.children.append(twin)
                if c.children:
                    stack.append((c, twin))
        return top

    @property
    def element(self) -> bool:
        return self.tag[0] != "#"

    @property
    def elements(self) -> list[Node]:
        return [c for c in self.children if c.tag[0] != "#"]

    @property
    def classes(self) -> list[str]:
        return self.attrs.get("class", "").split()

    def walk(self) -> list[Node]:
        """The nodes below in document order, as they are when the walk begins."""
        out: list[Node] = []
        stack = self.children[::-1]
        while stack:
            node = stack.pop()
            out.append(node)
            if node.children:
                stack += node.children[::-1]
        return out

    def all(self, *tags: str) -> list[Node]:
        """The elements below, in document order; with tags, only those."""
        if tags:
            return [n for n in self.walk() if n.tag in tags]
        return [n for n in self.walk() if n.tag[0] != "#"]

    def outside(self, *tags: str) -> list[Node]:
        """The elements below, in document order, that aren't within such tags; the tags themselves are among them."""
        out: list[Node] = []
        stack = self.children[::-1]
        while stack:
            node = stack.pop()
            if node.tag[0] != "#":
                out.append(node)
            if node.children and node.tag not in tags:
                stack += node.children[::-1]
        return out

    def up(self) -> Iterator[Node]:
        node = self.parent
        while node is not None:
            yield node
            node = node.parent

    def inside(self, *tags: str) -> bool:
        node = self.parent
        while node is not None:
            if node.tag in tags:
                return True
            node = node.parent
        return False

    def attached(self) -> bool:
        return any(n.tag == "#document" for n in self.up()) or self.parent is not None

    @property
    def text(self) -> str:
        return self.data if self.tag == "#text" else "".join([n.data for n in self.walk() if n.tag == "#text"])

    def first(self, selector: str) -> Node | None:
        found = self.select(selector)
        return found[0] if found else None

    def select(self, selector: str) -> list[Node]:
        bare, fits = compiled(selector)
        return [n for n in self.walk() if (n.attrs or bare and n.tag[0] != "#") and fits(n)]

    def next_element(self) -> Node | None:
        return next((n for n in self.parent.children[self.place + 1 :] if n.element), None) if self.parent else None

    def previous_element(self) -> Node | None:
        return next((n for n in self.parent.children[: self.place][::-1] if n.element), None) if self.parent else None


def text_node(data: str) -> Node:
    return Node("#text", data=data)


def attributes(source: str) -> dict[str, str]:
    """Attribute names in lower case; of repeats the first counts."""
    found: dict[str, str] = {}
    if not source or source.isspace():
        return found
    for name, *values in _ATTR.findall(source):
        found.setdefault(name.lower(), unescape(next(filter(None, values), "")))
    return found


def parse(html: str) -> Node:
    """The document of a page."""
    document = Node("#document")
    root = document.append(Node("html"))
    head, body = root.append(Node("head")), root.append(Node("body"))
    stack, active, in_head, at = [body], [], True, 0
    opened: Counter[str] = Counter()  # how many of each tag the stack holds

    def push(node: Node) -> None:
        stack.append(node)
        opened[node.tag] += 1

    def close(i: int) -> None:
        for node in stack[max(i, 1) :]:
            opened[node.tag] -= 1
        del stack[max(i, 1) :]

    def find(tags: set[str], barrier: set[str]) -> int | None:
        if not any(opened[t] for t in tags):
            return None
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                return i
            if stack[i].tag in barrier:
                return None
        return None

    def reopen() -> None:
        """Opens again the formatting elements that a block has closed, all after the last one that is still open."""
        first = len(active)
        while first and not (opened[active[first - 1].tag] and any(n is active[first - 1] for n in reversed(stack))):
            first -= 1
        for k in range(first, len(active)):
            if len(stack) >= DEEPEST:
                return
            active[k] = stack[-1].append(Node(active[k].tag, dict(active[k].attrs)))
            push(active[k])

    def remember(node: Node) -> None:
        """For reopen(); of elements alike, the last three."""
        alike = [n for n in active if n.tag == node.tag and n.attrs == node.attrs]
        if len(alike) >= 3:
            active.remove(alike[0])
        active.append(node)

    def add_text(data: str) -> None:
        nonlocal in_head
        if not data:
            return
        if "&" in data:
            data = unescape(data)
        if not data.isspace():
            in_head = False
            if active:
                reopen()
        elif in_head:
            return
        to = stack[-1]
        if len(stack) >= DEEPEST:  # its own cell or item may not have been opened
            to = next(n for n in reversed(stack) if n.tag not in HOLDS_NO_TEXT)
        last = to.children[-1:]
        if last and last[0].tag == "#text":
            last[0].data += data
        else:
            to.append(text_node(data))

    pos = 0
    while (m := _TOKEN.search(html, pos)) is not None:
        add_text(html[at : m.start()])
        at = pos = m.end()
        comment, doctype, end, tag, source = m.groups()
        if comment is not None:
            (head if in_head else stack[-1]).append(Node("#comment", data=comment))
        elif doctype is not None:
            if not any(c.tag == "#doctype" for c in document.children):
                root.before(Node("#doctype", data=doctype))
        elif tag is None:
            continue
        elif end:
            tag = tag.lower()
            if tag in ("html", "head", "body"):
                in_head = in_head and tag != "head"
                continue
            i = find({tag}, {"td", "th", "table"} if tag not in ("td", "th", "tr", "tbody", "thead", "tfoot", "table") else set())
            for k in range(len(active) - 1, -1, -1):
                if active[k].tag == tag:
                    del active[k]
                    break
            if i is not None:
                close(i)
            elif tag == "p":
                stack[-1].append(Node("p"))
            elif tag == "br":
                stack[-1].append(Node("br"))
        else:
            tag, attrs, empty = tag.lower(), attributes(source), source.rstrip().endswith("/")
            if tag in ("html", "head", "body"):
                node = {"html": root, "head": head, "body": body}[tag]
                node.attrs = {**attrs, **node.attrs}
                in_head = in_head and tag != "body"
                continue
            if in_head and tag not in HEAD_ONLY:
                in_head = False
            if tag in ENDS_P and (i := find({"p"}, {"td", "th", "table", "button", "object"})) is not None:
                close(i)
            if tag in HEADINGS and stack[-1].tag in HEADINGS:
                close(len(stack) - 1)
            if tag in SIBLINGS and (i := find(SIBLINGS[tag], SCOPE[tag])) is not None:
                while i > 1 and stack[i - 1].tag in SIBLINGS[tag]:
                    i -= 1
                close(i)
            if tag == "a" and (i := find({"a"}, {"td", "th", "table"})) is not None:
                close(i)
                active[:] = [n for n in active if n.tag != "a"]
            if tag not in ENDS_P and tag not in SIBLINGS and not in_head and tag not in HEAD_ONLY:
                reopen()
            node = (head if in_head else stack[-1]).append(Node(tag, attrs))
            if tag in VOID or empty and stack[-1].tag in ("svg", "math"):
                continue
            if tag in RAW_TEXT or tag in ESCAPABLE:
                stop = re.compile(rf"</{tag}[\s/>]", re.I).search(html, at)
                data = html[at : stop.start() if stop else len(html)]
                if data:
                    node.append(text_node(unescape(data) if tag in ESCAPABLE else data))
                at = pos = html.find(">", stop.start()) + 1 if stop else len(html)
                continue
            if in_head:
                stop = re.compile(rf"</{tag}[\s/>]", re.I).search(html, at)
                for c in fragment(html[at : stop.start() if stop else len(html)]):
                    node.append(c)
                at = pos = html.find(">", stop.start()) + 1 if stop else len(html)
                continue
            if len(stack) >= DEEPEST:
                continue
            push(node)
            if tag in FORMATTING:
                remember(node)
    add_text(html[at:])
    return document


def fragment(html: str) -> list[Node]:
    """The nodes of a piece of a body."""
    body = body_of(parse("<body>" + html))
    found = list(body.children)
    for n in found:
        n.detach()
    return found


def body_of(document: Node) -> Node:
    own = next((n for top in document.children if top.tag == "html" for n in top.children if n.tag == "body"), None)
    return own or next((n for n in document.walk() if n.tag == "body"), document)


def serialize(node: Node) -> str:
    """HTML of a node and what is below."""
    out: list[str] = []
    stack: list[Node | str] = [node]
    while stack:
        n = stack.pop()
        if isinstance(n, str):
            out.append(n)
        elif n.tag == "#text":
            out.append(n.data if n.parent is not None and n.parent.tag in RAW_TEXT else escape(n.data, quote=False).replace("\xa0", "&nbsp;"))
        elif n.tag == "#comment":
            out.append(f"<!--{n.data}-->")
        elif n.tag == "#doctype":
            out.append(f"<!{'DOCTYPE' + n.data[7:]}>")
        else:
            if n.element:
                attrs = "".join(' {}="{}"'.format(k, v.replace("&", "&amp;").replace("\xa0", "&nbsp;").replace('"', "&quot;")) for k, v in n.attrs.items())
                out.append(f"<{n.tag}{attrs}>")
                if n.tag in VOID:
                    continue
                stack.append(f"</{n.tag}>")
            stack += n.children[::-1]
    return "".join(out)


def inner_html(node: Node) -> str:
    return "".join(map(serialize, node.children))


_PART = re.compile(r"""([\w-]+|\*)|\.([\w-]+)|#([\w-]+)|\[\s*([\w-]+)\s*(?:([~^*$|]?=)\s*(?:"([^"]*)"|'([^']*)'|([^\]\s]+))\s*)?\]""")
_COMPILED: dict[str, tuple[bool, Callable[[Node], bool]]] = {}
_TESTS = {
    "=": lambda have, want: have == want, "~=": lambda have, want: want in have.split(), "^=": lambda have, want: have.startswith(want),
    "$=": lambda have, want: have.endswith(want), "*=": lambda have, want: want in have, "|=": lambda have, want: have == want or have.startswith(want + "-"),
}


def _compound(source: str) -> Callable[[Node], bool]:
    tests: list[Callable[[Node], bool]] = []
    at = 0
    while at < len(source):
        m = _PART.match(source, at)
        if not m:
            raise ValueError(f"not a selector: {source}")
        tag, cls, own, name, op, *values = m.groups()
        if tag and tag != "*":
            tests.append(lambda n, tag=tag.lower(): n.tag == tag)
        elif cls:
            tests.append(lambda n, cls=cls: cls in n.attrs.get("class", "") and cls in n.classes)
        elif own:
            tests.append(lambda n, own=own: n.attrs.get("id") == own)
        elif name and not op:
            tests.append(lambda n, name=name.lower(): name in n.attrs)
        elif name:
            value = next((v for v in values if v is not None), "")
            tests.append(lambda n, name=name.lower(), value=value, test=_TESTS[op]: name in n.attrs and test(n.attrs[name], value))
        at = m.end()
    return tests[0] if len(tests) == 1 else lambda n: all(t(n) for t in tests)


def _chain(parts: list[tuple[str, Callable[[Node], bool]]]) -> Callable[[Node], bool]:
    if len(parts) == 1:
        return parts[0][1]

    def fits(node: Node, i: int = len(parts) - 1) -> bool:
        how, test = parts[i]
        if not node.element or not test(node):
            return False
        if i == 0:
            return True
        if how == ">":
            return node.parent is not None and fits(node.parent, i - 1)
        return any(fits(a, i - 1) for a in node.up())

    return fits


def compiled(selector: str) -> tuple[bool, Callable[[Node], bool]]:
    """(whether an element without attributes can fit, a test) for a list of selectors: tags, classes, ids, attributes, descendants and children."""
    if selector not in _COMPILED:
        options = []
        for one in re.split(r",(?![^\[]*\])", selector):
            words = re.findall(r">|(?:\[[^\]]*\]|[^\s>\[])+", one)
            parts, how = [], " "
            for w in words:
                if w == ">":
                    how = ">"
                else:
                    parts.append((how, _compound(w)))
                    how = " "
            options.append(_chain(parts))
        bare = any(re.fullmatch(r"[\w*-]+", one.split()[-1]) for one in re.split(r",(?![^\[]*\])", selector))
        _COMPILED[selector] = (bare, options[0] if len(options) == 1 else lambda n: any(o(n) for o in options))
    return _COMPILED[selector]
