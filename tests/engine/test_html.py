from pagequern.html.dom import body_of, fragment, inner_html, parse, serialize


def body(html):
    return inner_html(body_of(parse(html)))


def test_unclosed_paragraphs_items_and_cells():
    assert body("<p>a<p>b<ul><li>1<li>2</ul>") == "<p>a</p><p>b</p><ul><li>1</li><li>2</li></ul>"
    assert body("<table><tr><td>1<td>2<tr><td>3</table>") == "<table><tr><td>1</td><td>2</td></tr><tr><td>3</td></tr></table>"


def test_unclosed_formatting_opens_again():
    assert body("<p><b>x<p>y</b>z") == "<p><b>x</b></p><p><b>y</b>z</p>"


def test_raw_text_and_references():
    d = parse('<title>a &amp; b</title><script>var t="</p>";</script><p title="&lt;">&copy; 1 < 2')
    assert d.first("title").text == "a & b"
    assert d.first("script").text == 'var t="</p>";'
    assert d.first("p").attrs == {"title": "<"} and d.first("p").text == "© 1 < 2"


def test_serialize_round_trip():
    html = '<html lang="en"><head><title>t</title></head><body><p class="a b">x &amp; y<br>z</p></body></html>'
    assert serialize(parse(html)) == html


def test_selectors():
    d = parse('<div id="a" class="x y"><ul><li data-k="v1">1</li><li>2</li></ul></div><p class="y">p</p>')
    assert [n.text for n in d.select("li")] == ["1", "2"]
    assert [n.text for n in d.select("#a .y, p.y, [data-k^=v], div > ul > li[data-k='v1']")] == ["1", "p"]
    assert d.first("div.x.y ul") is not None and d.first("ul > p") is None
    assert [n.tag for n in d.select("[class~=y]")] == ["div", "p"]


def test_fragment_and_empty():
    assert [n.tag for n in fragment("<i>a</i>b")] == ["i", "#text"]
    assert serialize(parse("")) == "<html><head></head><body></body></html>"
