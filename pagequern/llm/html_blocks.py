"""Main text of web pages by a recurrent block labeller.

A page is the sequence of its leaf blocks. A block is the mean of hashed vectors of its tag path
(tags, words of classes and ids) and of its words, with a few measures of its text. A bidirectional
LSTM in numpy reads the sequence both ways, so that each block is labelled in view of the whole
page. It is trained on pages that a seeded generator writes: the usual forms of menus, headers,
notices, adverts, forms, sidebars, comments and footers around, and in, an article.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagequern.llm._page_blocks import Block, blocks
from pagequern.llm._shared import only
from pagequern.llm._text import words

BUCKETS, DIM, HIDDEN = 1 << 12, 16, 20
#: Training pages, passes, pages of a step, and the seed of all of it.
PAGES, EPOCHS, STEP, SEED = 1500, 6, 30, 5
#: Blocks that are labelled at once, padding included, about.
BATCH_BLOCKS = 1 << 14
_MEASURES = 5
_STOPS = np.zeros(256, np.int64)
_STOPS[list(b".!?,;")] = 1


@lru_cache(1 << 14)
def _path_buckets(path: tuple[str, ...]) -> np.ndarray:
    own = [*path, *("/" + t for t in path[-3:])] or [""]
    return np.array([xxhash.xxh32_intdigest(t) % BUCKETS for t in own])


def inputs(found: list[Block]) -> tuple:
    """For all blocks: buckets of their paths and how many each has, the same for their words, and a row of measures each."""
    path = [_path_buckets(b.path) for b in found]
    said = [b.text.encode() for b in found]
    n = np.array([*map(len, said)])
    offsets = np.concatenate([[0], np.cumsum(n)])
    data = np.frombuffer(b"".join(said), np.uint8)
    _, _, hashes, first = words(data, offsets)
    stops = np.diff(np.concatenate([[0], np.cumsum(_STOPS[data])])[offsets])
    linked = np.array([b.linked for b in found], float)
    place = np.arange(len(found)) / max(len(found), 1)
    measures = np.stack([np.log1p(n) / 5, np.minimum(linked / np.maximum(n, 1), 1), np.minimum(stops, 5) / 5, place, np.ones(len(found))], axis=1)
    return np.concatenate(path), np.array([*map(len, path)]), (hashes & np.uint64(BUCKETS - 1)).astype(np.int64), np.diff(first), measures


class Labeller:
    """The network. Sequences are padded at the end; padded steps keep the state and count nothing."""

    def __init__(self, seed: int = SEED):
        r = np.random.default_rng(seed)
        n_in = 2 * DIM + _MEASURES
        self.w = {"path": r.normal(0, 0.2, (BUCKETS, DIM)), "text": r.normal(0, 0.1, (BUCKETS, DIM)), "out": r.normal(0, 0.2, 2 * HIDDEN), "bias": np.zeros(1)}
        for side in "fb":
            self.w |= {f"{side}x": r.normal(0, 0.2, (n_in, 4 * HIDDEN)), f"{side}h": r.normal(0, 0.2, (HIDDEN, 4 * HIDDEN)), f"{side}c": np.zeros(4 * HIDDEN)}
            self.w[f"{side}c"][HIDDEN : 2 * HIDDEN] = 1  # gates remember at first
        self.w = {k: v.astype(np.float32) for k, v in self.w.items()}
        self.moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in self.w.items()}
        self.steps = 0

    def _embed(self, pages: list) -> tuple[np.ndarray, np.ndarray, list]:
        """(pages, blocks, inputs), the mask, and what went into the means."""
        longest, kind = max(len(p[4]) for p in pages), self.w["out"].dtype
        x, mask, used = np.zeros((len(pages), longest, 2 * DIM + _MEASURES), kind), np.zeros((len(pages), longest), kind), []
        place = np.concatenate([i * longest + np.arange(len(p[4])) for i, p in enumerate(pages)])
        mask.reshape(-1)[place] = 1
        flat = x.reshape(len(pages) * longest, -1)
        for which, name, at in ((0, "path", 0), (2, "text", DIM)):
            bucket, size = (np.concatenate([p[w] for p in pages]) for w in (which, which + 1))
            owner = np.repeat(np.arange(len(size)), size)
            ends = np.concatenate([np.zeros((1, DIM)), np.cumsum(self.w[name][bucket], axis=0, dtype=np.float64)])
            stop = np.cumsum(size)
            flat[place, at : at + DIM] = (ends[stop] - ends[stop - size]) / np.maximum(size, 1)[:, None]
            used.append((name, at, bucket, place[owner], (1 / np.maximum(size, 1)[owner]).astype(kind)))
        flat[place, 2 * DIM :] = np.concatenate([p[4] for p in pages])
        return x, mask, used

    def _run(self, side: str, x: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, list]:
        n, steps, _ = x.shape
        h, c, kept, out = np.zeros((n, HIDDEN), x.dtype), np.zeros((n, HIDDEN), x.dtype), [], np.zeros((n, steps, HIDDEN), x.dtype)
        given = x @ self.w[f"{side}x"] + self.w[f"{side}c"]
        for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
            z = given[:, t] + h @ self.w[f"{side}h"]
            gates = 1 / (1 + np.exp(-z[:, : 3 * HIDDEN]))
            new, (i, f, o) = np.tanh(z[:, 3 * HIDDEN :]), np.split(gates, 3, axis=1)
            m = mask[:, t : t + 1]
            c2 = f * c + i * new
            squashed = np.tanh(c2)
            kept.append((t, h, c, i, f, o, new, squashed, m))
            h, c = m * o * squashed + (1 - m) * h, m * c2 + (1 - m) * c
            out[:, t] = h
        return out, kept

    def forward(self, pages: list) -> tuple:
        x, mask, used = self._embed(pages)
        sides = [self._run(s, x, mask) for s in "fb"]
        hidden = np.concatenate([s[0] for s in sides], axis=2)
        return 1 / (1 + np.exp(-(hidden @ self.w["out"] + self.w["bias"]))), x, mask, used, sides, hidden

    def gradients(self, pages: list, labels: list[np.ndarray]) -> dict[str, np.ndarray]:
        """Of the mean log loss of the blocks, for all weights."""
        p, x, mask, used, sides, hidden = self.forward(pages)
        y = np.zeros_like(mask)
        for i, own in enumerate(labels):
            y[i, : len(own)] = own
        d = (p - y) * mask / mask.sum()
        g = {"out": np.einsum("nt,nth->h", d, hidden), "bias": np.array([d.sum()])}
        dx, d_hidden = np.zeros_like(x), d[..., None] * self.w["out"]
        for k, side in enumerate("fb"):
            w_h, w_x = self.w[f"{side}h"], self.w[f"{side}x"]
            dz_all, g_h = np.zeros((*x.shape[:2], 4 * HIDDEN), x.dtype), np.zeros_like(w_h)
            dh, dc = np.zeros((len(x), HIDDEN), x.dtype), np.zeros((len(x), HIDDEN), x.dtype)
            for t, h, c, i, f, o, new, squashed, m in reversed(sides[k][1]):
                dh = dh + d_hidden[:, t, k * HIDDEN : (k + 1) * HIDDEN]
                dh2, dc2 = m * dh, m * dc
                dc2 = dc2 + dh2 * o * (1 - squashed**2)
                dz = np.concatenate([dc2 * new * i * (1 - i), dc2 * c * f * (1 - f), dh2 * squashed * o * (1 - o), dc2 * i * (1 - new**2)], axis=1)
                dz_all[:, t] = dz
                g_h += h.T @ dz
                dh, dc = (1 - m) * dh + dz @ w_h.T, (1 - m) * dc + dc2 * f
            g |= {f"{side}h": g_h, f"{side}x": x.reshape(-1, x.shape[2]).T @ dz_all.reshape(-1, 4 * HIDDEN), f"{side}c": dz_all.sum((0, 1))}
            dx += dz_all @ w_x.T
        flat = dx.reshape(-1, x.shape[2])
        for name, at, bucket, place, weight in used:
            order = np.argsort(bucket, kind="stable")
            each, first = np.unique(bucket[order], return_index=True)
            g[name] = np.zeros_like(self.w[name])
            if len(each):
                g[name][each] = np.add.reduceat((flat[place, at : at + DIM] * weight[:, None])[order], first, axis=0)
        return g

    def learn(self, pages: list, labels: list[np.ndarray], rate: float) -> None:
        """One step of Adam."""
        self.steps += 1
        for name, grad in self.gradients(pages, labels).items():
            first, second = self.moments[name]
            first += 0.1 * (grad - first)
            second += 0.01 * (grad**2 - second)
            self.w[name] -= rate * (first / (1 - 0.9**self.steps)) / (np.sqrt(second / (1 - 0.99**self.steps)) + 1e-8)

    def label(self, pages: list[list[Block]]) -> list[np.ndarray]:
        """Whether each block of each page is main text. Pages of like length go together."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = sorted((i for i in range(len(pages)) if pages[i]), key=lambda i: len(pages[i]))
        while order:
            longest = len(pages[order[-1]])
            now = [order.pop() for _ in range(min(len(order), max(1, BATCH_BLOCKS // longest)))]
            p = self.forward([inputs(pages[i]) for i in now])[0]
            for k, i in enumerate(now):
                out[i] = p[k, : len(pages[i])] >= 0.5
        return out


class Writer:
    """Writes training pages; text that belongs to the article stands between MAIN marks."""

    # Names under which sites file the parts of a page, and phrases they show there.
    NAMES = {
        "menu": "nav menu navigation navbar main-menu nav-links breadcrumbs breadcrumb topnav site-nav toc-menu tabs pagination pager",
        "header": "header site-header masthead top topbar page-header branding logo banner-top global-header",
        "notice": "cookie cookie-notice cookie-banner gdpr consent notice alert message popup modal overlay announcement privacy-notice",
        "ad": "ad ads advert advertisement ad-slot sponsored sponsor promo promotion banner adsbygoogle ad-container commercial",
        "side": "sidebar side secondary widget widget-area related related-posts recommended popular trending more-stories right-rail tags author-box",
        "form": "search search-form newsletter subscribe signup login contact-form form mailing-list",
        "share": "share social share-buttons social-links sharing follow tools",
        "comments": "comments comment-list commentlist responses discussion disqus reader-comments replies respond",
        "footer": "footer site-footer bottom page-footer colophon copyright legal credits foot",
        "article": "article post entry content main story post-body entry-content article-body main-content post-content text body page-content",
    }
    SAYS = {
        "menu": "Home|About|Contact|News|Sport|Blog|Archive|Next|Previous|Products|Help|Log in",
        "header": "Welcome|Home|Skip to content|Your daily site|Menu|Search",
        "notice": "We use cookies to improve your experience.|Accept all|Decline|This site uses cookies|Please update your browser.",
        "ad": "Advertisement|Sponsored|Buy now|Limited offer!|Click here|Ad|Shop the sale today.",
        "side": "Related|Popular posts|You may also like|Read more|Recent posts|Tags|Categories|About the author",
        "form": "Subscribe|Enter your email|Search|Sign up for our newsletter|Name|Send|Password",
        "share": "Share|Tweet|Like|Follow us|Print|Email this",
        "comments": "Comments|Leave a reply|Reply|3 responses|Log in to comment|Great post, thanks!|Report",
        "footer": "Copyright|All rights reserved.|Privacy policy|Terms of use|Contact|Imprint|© 2024",
    }
    MAIN = ("\x02", "\x03")

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        letters = [self.r.choice(("th e an in er on re ed nd ha at en", "é au eux le ion ent qu re ai", "sch ein ung ich er be ge ß ü", "ción os as do ra la que mi ñ")), "st ing ou la pa ri no mo sa te lu ka"]
        self.parts = " ".join(letters).split()

    def words(self, low: int, high: int) -> str:
        found = ["".join(self.r.choices(self.parts, k=self.r.randint(1, 4))) for _ in range(self.r.randint(low, high))]
        if self.r.random() < 0.1:
            found = " | ".join(found).split(" ")
        said = [w + (self.r.choice(",.") if self.r.random() < 0.12 else "") for w in found]
        return " ".join(said).capitalize() + self.r.choice(("", ".", "."))

    def name(self, kind: str) -> str:
        word = self.r.choice(self.NAMES[kind].split())
        extra = self.r.choice(("", "", f" {self.r.choice(('block', 'wrapper', 'box', 'inner', 'clearfix', 'row', 'col-4', 'x12'))}", f"-{self.r.choice(('1', 'inner', 'wrap', 'top'))}"))
        return f' {self.r.choice(("class", "class", "class", "id"))}="{word}{extra}"'

    def say(self, kind: str) -> str:
        if self.r.random() < 0.45:
            return self.r.choice(self.SAYS[kind].split("|"))
        return self.words(1, 4) if self.r.random() < 0.5 else self.words(5, 40)

    def links(self, kind: str) -> str:
        items = [f'<a href="/{i}">{self.say(kind) if self.r.random() < 0.3 else self.words(1, 2)}</a>' for i in range(self.r.randint(2, 9))]
        form = self.r.random()
        if form < 0.65:
            return "<ul>" + "".join(f"<li>{x}</li>" if self.r.random() < 0.9 else f"<li>{x}" for x in items) + "</ul>"
        return (" | " if form < 0.8 else " ").join(items)

    def part(self, kind: str) -> str:
        """One part that isn't article, in one of the forms that it takes."""
        r = self.r
        tag = {"menu": "nav", "header": "header", "footer": "footer", "side": "aside", "form": "form", "comments": "section", "ad": "aside"}.get(kind, "div")
        named = r.random() < 0.6
        tag, name = (tag, self.name(kind) if r.random() < 0.5 else "") if not named and tag not in ("div", "section") else (r.choice(("div", "div", "section", "aside") if kind in ("side", "ad", "notice") else ("div", "div", "section")), self.name(kind))
        if kind == "menu":
            inner = self.links(kind)
        elif kind == "form":
            inner = f"<label>{self.say(kind)}</label><input name=q><p>{self.say(kind)}</p>" + ("<button>Go</button>" if r.random() < 0.5 else "")
            tag = "form" if r.random() < 0.6 else tag
        elif kind == "comments":
            one = r.choice(("<div class=comment><p>{}</p></div>", "<li><cite>{}</cite><p>{}</p></li>", "<article class=comment-body><h4>{}</h4><p>{}</p></article>", "<p>{}</p>"))
            inner = f"<h3>{self.say(kind)}</h3>" + "".join(one.format(*(self.words(2, 30) for _ in range(one.count("{}")))) for _ in range(r.randint(1, 5)))
        elif kind == "side":
            inner = f"<h3>{self.say(kind)}</h3>" + r.choice((self.links(kind), f"<p>{self.words(3, 25)}</p>"))
        elif kind == "footer":
            inner = r.choice((f"&copy; {self.words(1, 3)} &middot; {self.words(2, 12)}", self.links(kind), f"<p>{self.say(kind)}</p><small>{self.say(kind)}</small>"))
        elif kind == "header":
            inner = r.choice((f"<a href=/>{self.say(kind)}</a>", f"<h2>{self.say(kind)}</h2><p>{self.words(2, 8)}</p>", f"<p>{self.say(kind)}</p>" + self.links("menu")))
        else:
            inner = r.choice((self.say(kind), f"<p>{self.say(kind)}</p>", f"<p>{self.words(4, 40)}</p>", f"<a href=x>{self.say(kind)}</a>"))
        return f"<{tag}{name}>{inner}" + (f"</{tag}>" if kind != "footer" or r.random() < 0.9 else "")

    def article(self) -> str:
        r, (a, b) = self.r, self.MAIN
        out = [f"<h1>{a}{self.words(2, 12)}{b}</h1>"] if r.random() < 0.85 else []
        for _ in range(r.randint(0, 9) if r.random() < 0.85 else r.randint(10, 70)):
            form = r.random()
            if form < 0.55:
                out.append(f"<p>{a}{self.words(1, 90)}{b}</p>")
            elif form < 0.68:
                out.append(f"<p><b>{a}{self.words(3, 60)}{b}<br>" if r.random() < 0.5 else f"<p>{a}{self.words(3, 60)}{b}")
            elif form < 0.76:
                out.append(f"<h2>{a}{self.words(1, 7)}{b}</h2>")
            elif form < 0.83:
                out.append("<ul>" + "".join(f"<li>{a}{self.words(2, 18)}{b}</li>" for _ in range(r.randint(2, 5))) + "</ul>")
            elif form < 0.87:
                out.append(f"<blockquote><p>{a}{self.words(5, 30)}{b}</p></blockquote>")
            elif form < 0.9:
                out.append(f"<figure><img src=x><figcaption>{a}{self.words(2, 12)}{b}</figcaption></figure>")
            elif form < 0.93:
                out.append(f"<table><tr><td>{a}{self.words(1, 3)}{b}</td><td>{a}{self.words(1, 3)}{b}</td></tr></table>")
            else:
                out.append(self.part(r.choice(("ad", "share", "side", "notice", "form"))))
        if not any(a in x for x in out) or r.random() < 0.3:
            out.append(f"<p>{a}{self.words(1, 60)}{b}</p>")
        if r.random() < 0.15:
            out.append(self.part(r.choice(("comments", "share", "side"))))
        form = r.random()
        tag = "article" if form < 0.5 else "main" if form < 0.65 else "div"
        name = self.name("article") if tag == "div" and r.random() < 0.9 or r.random() < 0.3 else ""
        body = f"<{tag}{name}>{''.join(out)}</{tag}>"
        return f"<main>{body}</main>" if r.random() < 0.15 else f"<div class=container>{body}</div>" if r.random() < 0.15 else body

    def page(self) -> str:
        r = self.r
        some = lambda kinds, most: [self.part(r.choice(kinds)) for _ in range(r.randint(0, most))]
        before = some(("header", "menu", "menu", "notice", "ad", "form", "share"), 4)
        after = some(("side", "ad", "comments", "share", "form", "notice", "menu"), 4) + some(("footer",), 1)
        if r.random() < 0.4:
            before.append(f'<div class="{r.choice(self.NAMES["ad"].split())}">{self.words(3, 40)}</div>')
        if r.random() < 0.3:
            after.append(self.part("footer"))
        return f"<html><head><title>{self.words(2, 8)}</title></head><body>{''.join([*before, self.article(), *after])}</body></html>"


def training_pages(n: int, seed: int) -> Iterator[tuple[list[Block], np.ndarray]]:
    """(blocks, whether each is main text) of n written pages."""
    a, b = Writer.MAIN
    for i in range(n):
        found = blocks(Writer(seed * 1_000_003 + i).page())
        main = np.array([a in x.text for x in found], float)
        for x in found:
            x.text = " ".join(x.text.replace(a, "").replace(b, "").split())
        yield found, main


@lru_cache(2)
def trained(pages: int = PAGES, epochs: int = EPOCHS, seed: int = SEED) -> Labeller:
    """A labeller, trained once in a process; the same for the same arguments."""
    given = [(inputs(found), main) for found, main in training_pages(pages, seed) if found]
    net, r = Labeller(seed), np.random.default_rng(seed)
    for epoch in range(epochs):
        order = sorted(r.permutation(len(given)).tolist(), key=lambda i: len(given[i][1]) // 6)
        steps = [order[i : i + STEP] for i in range(0, len(order), STEP)]
        for k in r.permutation(len(steps)).tolist():
            net.learn([given[i][0] for i in steps[k]], [given[i][1] for i in steps[k]], 0.01 * (1 - epoch / epochs) + 0.001)
    return net


def main_texts(html: list[str | None], net: Labeller) -> list[str]:
    """The main text of each page: its blocks in order, one to a line; empty if there is none. Null is empty."""
    found = [blocks(h or "") for h in html]
    return ["\n".join(b.text for b, keep in zip(own, label, strict=True) if keep) for own, label in zip(found, net.label(found), strict=True)]


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", net: Labeller | None = None) -> DataFrame:
    """One row per input row: page_id, url, text.

    Null or empty html gives empty text, as do pages without any block of main text. Blocks are
    whole, however long; character references are decoded. Repeated rows give repeated results;
    empty input gives no rows; other columns are ignored.
    """
    weights = (net or trained()).w
    names = (id_col, url_col, html_col)
    types = dict(pages.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Labeller.__new__(Labeller)
        own.w = weights
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(main_texts(part.column(2).to_pylist(), own), pa.string())], names=["page_id", "url", "text"])

    return only(pages, *names).mapInArrow(run, f"page_id {types.get(id_col, 'string')}, url {types.get(url_col, 'string')}, text string")


def digest(found: DataFrame) -> DataFrame:
    """The result of extract() in the columns of the registered query."""
    return found.withColumn("n_chars", F.length("text").cast("long"))
