import pytest

from pagequern.extract.markdown import html_to_markdown as md
from pagequern.extract.sites import bbcode_to_html, unix_time
from pagequern.extract.text import html_to_text


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<h1>A</h1><h3>B</h3>", "## A\n\n### B"), ("<p>a_b [c] `d` \\</p>", "a\\_b \\[c\\] \\`d\\` \\\\"), ("<p><b> x </b><i></i><s>y</s><mark>z</mark></p>", "**x**~~y~~==z=="),
        ('<a href="https://e.example">x</a>', "[x](https://e.example/)"), ('<a href="javascript:void(0)">x</a>', "x"), ('<a href="/x"></a>', ""), ('<img src="data:x" alt="a"><p>t</p>', "t"),
        ('<img srcset="/a.png 100w, /b.png 300w" src="/c.png" alt="q">', "![q](/b.png)"), ("<p>10<sup>2</sup></p>", "10[^2]"), ("<p>x<sup>th</sup></p>", "x<sup>th</sup>"),
        ("<pre><code>a\n  b</code></pre>", "```\na\n  b\n```"), ("<p><code>a`b</code></p>", "``a`b``"), ("<table><tr><td>only</td></tr></table>", "only"), ("<p>a<br>b</p>", "a  \nb"),
        ('<table><tr><td colspan="2">x</td></tr></table>', '<table><tr><td colspan="2">x</td></tr></table>'), ("<script>x</script>", ""), ("<dl><dt>a</dt><dd>b</dd></dl>", "a\n\nb"), ("", ""),
    ],
)
def test_markdown(html, want):
    assert md(html) == want


def test_title_heading_goes_only_at_the_start():
    assert md("<h1>T</h1><p>x</p>", "t") == "x"
    assert md("<h1>T</h1><p>x</p>", "T | Site") == "x"
    assert md("<p>x</p><h1>T</h1>", "T") == "x\n\n## T"


def test_links_resolve_against_the_page():
    assert md('<a href="b">x</a> <a href="#c">y</a>', "", "https://e.example/a/") == "[x](https://e.example/a/b)\n\n[y](#c)"


def test_text():
    assert html_to_text("<h1>A</h1><p>b <b>c</b></p><ul><li>1</li><li>2</li></ul><img alt='pic'><style>x</style>") == "A\n\nb c\n\n• 1\n• 2[Image: pic]"


def test_bbcode():
    assert bbcode_to_html("[b]x[/b]\n[olist][*]1[*]2[/olist][url=javascript:a]n[/url][p]a\nb[/p]") == "<strong>x</strong><br><ol><li>1</li><li>2</li></ol>n<p>a<br>b</p>"
    assert unix_time(1700000000) == "2023-11-14T22:13:20.000Z"
