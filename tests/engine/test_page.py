import pytest

from pagequern.extract import cleanup, sites, standardize
from pagequern.extract.options import Options
from pagequern.extract.page import extract, messages
from pagequern.html.dom import body_of, inner_html, parse

LONG = "word " * 210


def after(step, html):
    document = parse(html)
    step(document)
    return inner_html(body_of(document))


def test_clutter_goes_and_few_words_bring_it_back():
    html = "<body><nav>menu</nav><article><p>{}</p></article><footer>foot</footer></body>"
    assert "menu" not in extract(html.format(LONG))["content"]
    assert "menu" in extract(html.format("short"))["content"]
    assert "menu" in extract(html.format(LONG), options=Options(remove_exact_selectors=False, remove_partial_selectors=False))["content"]


def test_output_modes():
    html = f"<body><p>{LONG}</p></body>"
    assert extract(html)["content_markdown"] is None
    assert extract(html, options=Options(separate_markdown=True))["content_markdown"].startswith("word")
    assert extract(html, options=Options(markdown=True))["content"].startswith("word")


@pytest.mark.parametrize("html", [None, "", "<", "plain", "<body>", "</p></div>", "<p>" * 500])
def test_odd_pages_give_a_record(html):
    assert extract(html)["_error"] is None


@pytest.mark.parametrize(
    ("step", "html", "want"),
    [
        (cleanup.hidden, '<p style="display: none">a</p><p class="md:hidden">b</p><p class="hidden md:block">c</p><p hidden>d</p>', '<p class="hidden md:block">c</p><p hidden="">d</p>'),
        (cleanup.small_images, '<img src=a width=16 height=16><img src=b width=100><img><img data-src=c>', '<img src="b" width="100"><img data-src="c">'),
        (cleanup.metadata_block, "<h1>T</h1><p>May 4, 2024</p><p>prose</p>", "<h1>T</h1><p>prose</p>"),
        (cleanup.content_patterns, "<p>12 likes</p><p>5 min read</p><p>Share</p><p>real text here</p><h2>Related posts</h2><ul><li>x</li></ul>", "<p>real text here</p>"),
        (cleanup.byline_near_start, "<h1>T</h1><p>By Jane Doe</p><p>x</p>", "<h1>T</h1><p>x</p>"),
        (standardize.headings, '<h2>A<a href="#a">#</a></h2><h2>a</h2><p>x</p><h3>end</h3>', "<h2>A</h2><p>x</p>"),
        (standardize.flatten, "<div><section><p>x</p></section></div>", "<p>x</p>"),
        (standardize.semantics, '<p><span>a</span> <a href="javascript:x">b</a></p>', "<p>a b</p>"),
        (standardize.images, '<img data-src="/a.png" src="data:x"><img src="/pixel.gif" width=1 height=1>', '<img src="/a.png">'),
        (standardize.tables, "<table><tr><td>one</td></tr></table><table><tr><td></td></tr></table>", "one"),
        (standardize.callouts, "<blockquote><p>[!WARNING]\nhot</p></blockquote>", '<div class="callout" data-callout="warning"><div class="callout-title"><div class="callout-title-inner">Warning</div></div><div class="callout-content"><p>hot</p></div></div>'),
        (standardize.code_blocks, '<div class="highlight"><pre><span class="lineno">1</span><code class="language-rust">let x;</code></pre></div>', '<pre><code class="language-rust" data-lang="rust">let x;</code></pre>'),
    ],
)
def test_steps(step, html, want):
    assert after(step, html) == want


def test_srcset():
    assert standardize.best_of_srcset("/a.png 1x, /b.png 2x") == "/b.png"
    assert standardize.best_of_srcset("/a.png 300w, /b.png 300w") == "/a.png"


def test_math_of_text_and_images():
    assert 'data-latex="\\frac{1}{2}"' in after(standardize.math, "<p>so $\\frac{1}{2}$ it costs $5 and $6</p>")
    assert "x^2" in after(standardize.math, '<img src="https://latex.codecogs.com/png?latex=x^2">')


def test_relative_links_resolve():
    assert 'href="https://e.example/b"' in extract(f'<body><p>{LONG}<a href="/b">l</a></p></body>', "https://e.example/a")["content"]


def test_chat_and_thread():
    got = messages('<div data-message-author-role="user">hi</div><div data-message-author-role="assistant">yo</div>', "https://chatgpt.com/c/1")
    assert [(m.author, m.html) for m in got] == [("You", "hi"), ("ChatGPT", "yo")]
    page = '<article data-testid="tweet"><div data-testid="User-Name"><a href="/a">A</a></div><div data-testid="tweetText">one</div></article><article data-testid="tweet"><div data-testid="User-Name"><a href="/b">B</a></div><div data-testid="tweetText">two</div></article>'
    got = extract(page, "https://x.com/a/status/1")
    assert (got["extractor_type"], got["title"], got["author"]) == ("twitter", "@a on X", "@a") and "<blockquote>" in got["content"]


def test_handlers_that_find_nothing_leave_the_general_way():
    assert extract("<p>x</p>", "https://github.com/a/b")["extractor_type"] is None
    assert extract("", "https://chatgpt.com/c")["extractor_type"] == "chatgpt"
    assert extract("<pre>[b]x[/b] [i]y[/i]</pre>")["extractor_type"] == "bbcode-data"
    assert extract("<pre>a[i] + b[i]</pre>")["extractor_type"] is None


@pytest.mark.parametrize(
    ("url", "html", "want"),
    [
        ("https://en.wikipedia.org/wiki/X", '<h1 id="firstHeading">X</h1><div class="mw-parser-output"><p>a</p><div class="navbox">n</div></div>', ("wikipedia", "X", "<p>a</p>")),
        ("https://u.medium.com/p", "<article><h1>T</h1><p>a</p></article>", ("medium", "T", "<h1>T</h1><p>a</p>")),
        ("https://u.substack.com/p/x", '<h1 class="post-title">T</h1><div class="body markup"><p>a</p></div>', ("substack", "T", "<p>a</p>")),
        ("https://leetcode.com/problems/x", '<div data-track-load="description_content"><p>a</p></div>', ("leetcode", "", "<p>a</p>")),
        ("https://lwn.net/Articles/1/", '<div class="PageHeadline"><h1>T</h1></div><div class="ArticleText"><main><p>a</p></main></div>', ("lwn", "T", "<p>a</p>")),
    ],
)
def test_articles_of_sites(url, html, want):
    got = extract(html, url)
    assert (got["extractor_type"], got["title"], got["content"]) == want


def test_registered_handler_comes_before_the_last():
    sites.register("mine", r"^https://mine\.example/", lambda root, head, url: sites.Found("<p>mine</p>"))
    try:
        assert extract("<p>x</p>", "https://mine.example/a")["extractor_type"] == "mine"
    finally:
        sites.ROUTES[:] = [r for r in sites.ROUTES if r[0] != "mine"]


def test_every_name_of_clutter_is_caught():
    from pagequern.extract.cleanup import PARTIAL, any_of, names_clutter
    from pagequern.html.dom import Node

    assert len(PARTIAL) == 529
    for name in PARTIAL:
        # names are compared in lower case, so the one with a capital fits none
        assert names_clutter(Node("div", {"id": f"x{name}x"}), any_of(PARTIAL)) == (name != "siteNotice")
    lost = "pop-up submenu siteheader site-name sharedaddy post_meta postmeta post_date posttitle recent_post section-nav pagefoot upsell similar_ reading-list prevnext comment-wrap might-like"
    for name in lost.split():
        assert names_clutter(Node("div", {"class": f"a {name}"}), any_of(PARTIAL)), name
