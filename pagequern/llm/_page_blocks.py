"""Leaf blocks of an HTML page: the runs of text between block-level tags, with the path of tags above."""

from __future__ import annotations

import re
from dataclasses import dataclass
from html import unescape

# HTML elements by the way they break text.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q ruby rt rp s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Elements whose content is text up to their own end tag, elements that show no text, and elements that leave the head open.
RAW = frozenset("script style noscript title textarea iframe".split())
HIDDEN = frozenset("template svg select".split())
CONTROLS = frozenset("button object option optgroup".split())  # blocks of their own that don't end a paragraph
HEAD_ONLY = frozenset("html head title base basefont bgsound link meta script style noscript noframes template".split())
# Start tags that end an unclosed svg or select.
BREAKS_OUT = {
    "svg": frozenset(
        "article aside b big blockquote body br center code dd div dl dt em embed footer h1 h2 h3 h4 h5 h6 head header hr i img li listing main menu meta nav nobr ol p pre ruby s section "
        "small span strike strong sub sup table tt u ul var".split()
    ),
    "select": frozenset("article aside blockquote body dl fieldset footer form h1 h2 h3 h4 h5 h6 header input li main nav ol p pre section select table td textarea th tr ul".split()),
}
#: Open elements at most, as in browsers; what is deeper has the path of its ancestors up to there.
DEEPEST = 512
CLOSED_BY = {"li": "li", "dt": "dd dt", "dd": "dd dt", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option", "optgroup": "optgroup option"}

_TAG = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>", re.S)
_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for tag in RAW}
_NAMED = re.compile(r"""\b(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


@dataclass
class Block:
    #: tokens of the elements above, outermost first
    path: tuple[str, ...]
    text: str
    #: characters of text in links
    linked: int


def tokens_of(tag: str, attributes: str) -> tuple[str, ...]:
    """What an element says about its content: its tag, the words of its class and id, its role, whether it is hidden."""
    found = [f"<{tag}>"]
    if attributes:
        for name, *values in _NAMED.findall(attributes):
            name, value = name.lower(), next(filter(None, values), "")
            if name == "style":
                found += ["hidden"] * bool(_HIDDEN.search(value))
            elif "hidden" in name:
                found += ["hidden"] * (value.lower() != "false")
            else:
                found += [f"{name[0]}:{w.lower()}" for w in _WORD.findall(value)]
    return tuple(found)


def blocks(html: str) -> list[Block]:
    """The blocks in page order. Text of scripts, styles, form values, drawings, templates and the head is none.

    Character references are decoded, and white space in a block becomes one space. An unclosed
    paragraph, list item or cell ends where the next begins, and what is open in it ends with it.
    A raw element is text up to its own end tag, whatever that text looks like. The head ends at
    the first element or text that can't be in it. A raw element that never ends takes the rest of
    the page, as in browsers.
    """
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    text: list[str] = []
    linked = at = links = heads = maths = pos = 0
    unseen: list[str] = []  # the hidden element that is open, and what is open in it

    def flush() -> None:
        nonlocal linked
        whole = " ".join("".join(text).split())
        if whole and not heads:
            out.append(Block(tuple(w for _, own in stack for w in own), whole, linked))
        text.clear()
        linked = 0

    def close(depth: int) -> None:
        nonlocal links, heads, maths
        for t, _ in stack[depth:]:
            links -= t == "a"
            heads -= t == "head"
            maths -= t == "math"
        del stack[depth:]

    def leave_head() -> None:
        if heads:
            close(next(i for i, (t, _) in enumerate(stack) if t == "head"))

    def add(piece: str) -> None:
        nonlocal linked
        if unseen:
            return
        if piece and not piece.isspace():
            leave_head()
        piece = unescape(piece)
        text.append(piece)
        linked += len(piece) if links else 0

    while (m := _TAG.search(html, pos)) is not None:
        if m.start() > at:
            add(html[at : m.start()])
        at = pos = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        closed = m[3].endswith("/")
        if not m[1] and tag in RAW:
            if tag not in HEAD_ONLY and not unseen:
                leave_head()
            if not closed:
                end = _END[tag].search(html, at)
                at = pos = end.end() if end else len(html)
            if tag not in ("script", "style", "noscript") and not unseen:
                text.append(" ")
            continue
        if unseen:
            if m[1]:
                if tag in unseen:
                    del unseen[len(unseen) - 1 - unseen[::-1].index(tag) :]
                    continue
                if unseen[0] == "template" or not any(t == tag for t, _ in stack):
                    continue
                unseen.clear()  # the end of an element around it
            elif tag in BREAKS_OUT.get(unseen[0], ()) and "foreignobject" not in unseen:
                unseen.clear()
                if tag == "select":
                    continue
            else:
                if tag not in VOID and not closed:
                    unseen.append(tag)
                continue
        if m[1]:
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
            if tag not in INLINE and tag != "math" and not (maths and any(t == "math" for t, _ in stack[:depth])):
                flush()
            if depth is not None:
                close(depth)
            continue
        if tag not in HEAD_ONLY:
            leave_head()
        if tag in HIDDEN:
            if not closed:
                unseen.append(tag)
            if tag != "template":
                text.append(" ")
            continue
        if maths and tag in BREAKS_OUT["svg"] and tag not in INLINE:
            close(next(i for i, (t, _) in enumerate(stack) if t == "math"))
        if tag not in INLINE and tag != "math" and not maths:
            flush()
            ends = CLOSED_BY.get(tag, "").split() or ([] if tag in CONTROLS else ["p"])
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in ends:
                    close(i)
                    break
                if stack[i][0] not in INLINE and stack[i][0] != "p":
                    break
        elif tag == "br":
            text.append(" ")
        if tag not in VOID and not m[3].endswith("/") and len(stack) < DEEPEST:
            stack.append((tag, tokens_of(tag, m[3])))
            links += tag == "a"
            heads += tag == "head"
            maths += tag == "math"
    add(html[at:])
    flush()
    return out
