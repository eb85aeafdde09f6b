import random
import re
from html import unescape
from html.parser import HTMLParser
from math import exp, tanh

import numpy as np
import pytest

from pagequern.llm import html_blocks, warc_fixity as wf
from pagequern.llm._page_blocks import blocks

SF = "/root/testdata/sf0.01"


def article(html):
    """Of the test pages: what the article element holds, block by block."""
    inner = html[html.index("<article>") + 9 : html.index("</article>")]
    parts = (" ".join(unescape(re.sub(r"<[^>]*>", " ", p)).split()) for p in re.split(r"</?(?:p|h1)\b[^>]*>", inner))
    return "\n".join(p for p in parts if p)


def test_blocks():
    found = blocks('<head><title>t</title></head><body><nav><a href=x>m</a></nav><p>a <b>b</b><br>c<p>d &amp;\n e<ul><li>1<li>2</ul><script>x<p></script>tail')
    assert [b.text for b in found] == ["m", "a b c", "d & e", "1", "2", "tail"]
    assert found[0].path == ("<body>", "<nav>") and found[0].linked == 1
    assert blocks("") == [] and blocks("<p>") == [] and [b.text for b in blocks("x")] == ["x"]


@pytest.mark.parametrize(
    "html, texts",
    [
        ("<p>a</p><script>for(var i=0;i<a.length;i++){x(a[i])}</script><p>b</p>", ["a", "b"]),
        ("<p>a</p><script>x = '<!--'</script><p>b</p><script></script><p>c", ["a", "b", "c"]),
        ("<datalist><option>1<option>2</datalist><p>b</p>", ["1", "2", "b"]),
        ("<p>a <button>go</button> b</p><object><p>c</p></object>", ["a", "go", "b", "c"]),
        ("<select><option>1<option>2</select><p>b</p>", ["b"]),
        ("<select><option>1<p>b</p>", ["b"]),
        ("<div><svg><g><text>x</text></div><p>b</p>", ["b"]),
        ("<svg><path><p>b</p>", ["b"]),
        ("<template><div><p>x</p><template>y</template></div>z</template><p>b</p>", ["b"]),
        ("<p>so <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds</p>", ["so x=1 holds"]),
        ("<math><mi>x<p>b<p>c", ["x", "b", "c"]),
        ("<head><title>t</title><meta charset=x><p>a</p><div>b</div>", ["a", "b"]),
        ("<head><style>p>a{}</style>\ntext <b>c</b>", ["text c"]),
        ("<!--><p>a</p><!-- x --!><p>b</p><!-- y --><textarea><p></textarea>c", ["a", "b", "c"]),
    ],
)
def test_blocks_after_raw_and_hidden_elements(html, texts):
    assert [b.text for b in blocks(html)] == texts


class Shown(HTMLParser):
    """The characters that a page shows, by the parser of the standard library."""

    def __init__(self):
        super().__init__()
        self.off, self.out = 0, []

    def handle_starttag(self, tag, attrs):
        self.off += tag in ("script", "style")

    def handle_endtag(self, tag):
        self.off -= tag in ("script", "style")

    def handle_data(self, data):
        if not self.off:
            self.out.append(data)


@pytest.mark.parametrize("seed", range(20))
def test_every_character_is_in_some_block(seed):
    r = random.Random(seed)
    parts = ["word", "a &amp; b", "x < y says", " 1 <2 ", "&eacute;t\u00e9", "<p>", "</p>", "<div class='a b'>", "</div>", "<b>", "</b>", "<br>", "<ul><li>", "</ul>", "<td>", "<button>", "<option>",
             "<h2>t</h2>", "<a href='x>y'>", "</a>", "<script>if(i<n){f('<p>')}</script>", "<style>a<b{}</style>", "<!-- <p> -->", "<img alt='<'>", "<math><mi>x</mi></math>", "<span\n id=q>", "</section>"]
    html = "<body>" + "".join(r.choice(parts) for _ in range(200))
    shown = Shown()
    shown.feed(html)
    shown.close()
    assert "".join("".join(b.text for b in blocks(html)).split()) == "".join("".join(shown.out).split())


def test_path_reaches_the_outermost_element():
    html = "<body><section class='comments'>" + "<div class='md:px-4 col-12 a b c'>" * 60 + "<p>reply</p>"
    assert blocks(html)[0].path[:3] == ("<body>", "<section>", "c:comments")
    assert html_blocks.inputs(blocks(html))[1][0] > 300
    found = blocks("<div>" * 20_000 + "x" + "</div>" * 20_000 + "y")
    assert [b.text for b in found] == ["x", "y"]


def naive(w, page):
    """The network on one page, number by number."""
    path, n_path, words, n_words, measures = page
    xs, at, to = [], 0, 0
    for k in range(len(measures)):
        means = []
        for name, bucket, low, n in (("path", path, at, n_path[k]), ("text", words, to, n_words[k])):
            means += [sum(float(w[name][b][d]) for b in bucket[low : low + n]) / max(n, 1) for d in range(html_blocks.DIM)]
        at, to = at + n_path[k], to + n_words[k]
        xs.append(means + [float(m) for m in measures[k]])
    hidden = html_blocks.HIDDEN
    sigmoid = lambda z: 1 / (1 + exp(-z))
    outs = []
    for side, steps in (("f", range(len(xs))), ("b", range(len(xs) - 1, -1, -1))):
        h, c, out = [0.0] * hidden, [0.0] * hidden, {}
        for t in steps:
            z = [sum(x * float(w[side + "x"][i][j]) for i, x in enumerate(xs[t])) + sum(v * float(w[side + "h"][i][j]) for i, v in enumerate(h)) + float(w[side + "c"][j]) for j in range(4 * hidden)]
            c = [sigmoid(z[hidden + j]) * c[j] + sigmoid(z[j]) * tanh(z[3 * hidden + j]) for j in range(hidden)]
            h = [sigmoid(z[2 * hidden + j]) * tanh(c[j]) for j in range(hidden)]
            out[t] = h
        outs.append(out)
    return [sigmoid(sum(v * float(o) for v, o in zip(outs[0][t] + outs[1][t], w["out"], strict=True)) + float(w["bias"][0])) for t in range(len(xs))]


def test_network_equals_a_scalar_one_and_its_gradients_are_right():
    pages = [html_blocks.inputs(found[:n]) for n, (found, _) in zip((3, 5, 7), html_blocks.training_pages(3, 9), strict=True)]
    net = html_blocks.Labeller(3)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    p = net.forward(pages)[0]
    for i, page in enumerate(pages):
        assert np.allclose(p[i, : len(page[4])], naive(net.w, page))
    labels = [np.arange(len(page[4])) % 2.0 for page in pages]

    def loss():
        p = net.forward(pages)[0]
        each = [-np.log(np.where(y > 0, p[i, : len(y)], 1 - p[i, : len(y)])) for i, y in enumerate(labels)]
        return np.concatenate(each).mean()

    grads, r = net.gradients(pages, labels), np.random.default_rng(0)
    for name, g in grads.items():
        places = np.argwhere(np.abs(g) > 1e-6)
        for at in map(tuple, places[r.permutation(len(places))[:6]]):
            old = net.w[name][at]
            found = []
            for step in (1e-5, -1e-5):
                net.w[name][at] = old + step
                found.append(loss())
            net.w[name][at] = old
            assert np.isclose((found[0] - found[1]) / 2e-5, g[at], rtol=1e-3, atol=1e-8), name


def test_main_text_of_the_test_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r for r in html_blocks.digest(html_blocks.extract(pages)).collect()}
    for p in pages.collect():
        assert got[p.page_id].text == article(p.html) and got[p.page_id].n_chars == len(got[p.page_id].text) and got[p.page_id].url == p.url


def test_unseen_written_pages():
    net, right, total = html_blocks.trained(), 0, 0
    for found, main in html_blocks.training_pages(200, 77):
        label = net.label([found])[0] if found else []
        right, total = right + sum(a == (b > 0) for a, b in zip(label, main, strict=True)), total + len(main)
    assert right / total > 0.99


def test_odd_pages(spark):
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<nav>x</nav>"), (4, "u", "<article>" + "<p>word word, more. " * 3000), (4, "u", "<p>"), (5, "u", "<a" * 50)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id bigint, url string, html string, text string")
    got = html_blocks.extract(df).collect()
    assert len(got) == 6 and all(r.text is not None for r in got)
    assert [len(r.text.split("\n")) for r in got if r.page_id == 4 and r.text] == [3000]
    assert html_blocks.extract(df.limit(0)).count() == 0


def pages_of(spark, n=60):
    rows = [(i, f"https://e.example/{i}", f"<p>page {i} é " + "x" * (i * 7 % 50)) for i in range(n)] + [(None, None, None), (3, "https://e.example/3", "<p>page 3 é " + "x" * 21), (7, "u", "")]
    return spark.createDataFrame([(*r, "c") for r in rows], "page_id bigint, url string, html string, record string")


@pytest.mark.parametrize("compression", ["none", "gzip"])
def test_archive_round_trip_and_audit(spark, tmp_path, compression):
    pages = pages_of(spark)
    found = wf.records(pages, shard_bytes=3000)
    wf.write_warc(found, str(tmp_path / "a"), compression)
    back = wf.read_warc(spark, str(tmp_path / "a"))
    drill = {(r.shard, r.start): r for r in wf.drill(pages, shard_bytes=3000, fanout=3).collect()}
    assert {(r.shard, r.start, r.end, r.sha256) for r in back.collect()} == {(r.shard, r.start, r.end, r.sha256) for r in drill.values()}
    assert sorted((r.body or b"").decode() for r in back.collect()) == sorted(r.html or "" for r in pages.collect())


@pytest.mark.parametrize("fanout", [2, 16])
def test_audit_finds_exactly_the_damage(spark, fanout):
    leaves = spark.createDataFrame([(s, i, i * 10, i * 10 + 10, f"{s}-{i}") for s in range(3) for i in range(20 * s + 1)], "shard bigint, idx bigint, start bigint, end bigint, sha256 string")
    bad = {(1, 4), (2, 0), (2, 39)}
    other = leaves.rdd.map(lambda r: (*r[:4], "bad" if (r[0], r[1]) in bad else r[4])).filter(lambda r: (r[0], r[1]) != (2, 40)).toDF(leaves.schema)
    mine, theirs = wf.tree(leaves, fanout), wf.tree(other, fanout)
    assert mine[-1].count() == 3
    got = {(r.shard, r.idx): (r.hash, r.other_hash) for r in wf.audit(mine, theirs, fanout).collect()}
    assert got == {(s, i): (f"{s}-{i}", "bad") for s, i in bad} | {(2, 40): ("2-40", None)}
    assert wf.audit(mine, mine, fanout).count() == 0


def test_damaged_record_does_not_hide_the_next():
    one = b"WARC/1.1\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    broken = one.replace(b": 5", b": 9")
    assert [b - a for a, b in wf.bounds(one + broken + one)] == [len(one)] * 3


def test_drill_of_nothing(spark):
    assert wf.drill(pages_of(spark).limit(0)).count() == 0
