"""Queries of the page extraction itself.

Some run over the table of pages. Others write a page for each row of another table and extract it,
so that the expected value follows from the row alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagequern.extract.options import Options
from pagequern.functions import html as H
from pagequern.operators import pages as P
from pagequern import sources
from pagequern.sources.files import parse_requests


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table, in partitions enough for all cores."""
    return P.spread(sources.read_table(spark, sf_dir, name))


def _markup(template: str, **values: Column) -> Column:
    """The template with {name} in place of the columns."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), value.cast("string"))
    return out


def _extracted(rows: DataFrame, key: str, html: Column, *fields: str, url: str = "https://www.news.example/a") -> DataFrame:
    made = rows.select(key, html.alias("html"), F.lit(url).alias("url"))
    return P.extract(made, keep=(key,)).select(key, *fields)


def _markdown(rows: DataFrame, key: str, html: Column) -> DataFrame:
    return rows.select(key, P.to_markdown(html).alias("markdown"))


def extract_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every field of every page, but the time it took."""
    return P.extract(read_table(spark, sf_dir, "pages"), Options(separate_markdown=True)).drop("parse_time")


def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "pages").select("page_id", P.to_text("html").alias("text"))


def dom_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.nodes(read_table(spark, sf_dir, "pages"))


def dom_tag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements of the kinds that the pages write out and that every parser keeps."""
    kept = P.nodes(read_table(spark, sf_dir, "pages")).where(F.col("tag").isin("a", "li", "nav", "article", "footer", "h1", "div", "script", "style", "title"))
    return kept.groupBy("page_id", "tag").agg(F.count("*").alias("n"))


def link_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each page's body, the share of text bytes in links."""
    body = P.nodes(read_table(spark, sf_dir, "pages")).where("tag = 'body'")
    return body.select("page_id", "text_bytes", "link_bytes", (F.col("link_bytes") / F.col("text_bytes")).alias("density"))


def head_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = _markup(
        '<html><head><title>ignored</title><meta property="og:title" content="{n}"><meta name="author" content="By {n}"><meta property="og:description" content="about {n}">'
        '<meta property="og:site_name" content="{m}"><meta name="publish_date" content="{k}"><meta property="og:image" content="/i/{k}.png"><link rel="icon" href="/f{k}.ico"></head><body><p>x</p></body></html>',
        n=F.col("c_name"), m=F.col("c_mktsegment"), k=F.col("c_custkey"),
    )
    return _extracted(read_table(spark, sf_dir, "customer"), "c_custkey", html, "title", "author", "description", "site", "published", "image", "favicon", "domain")


def schema_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = _markup(
        '<html><head><script type="application/ld+json">{"@graph":[{"@type":"Article","headline":"{n}","author":[{"name":"{n}"},{"name":"{m}"}],"datePublished":"{k}","publisher":{"name":"{m}"},"image":{"url":"/{k}.jpg"}}]}</script></head><body>x</body></html>',
        n=F.col("c_name"), m=F.col("c_mktsegment"), k=F.col("c_custkey"),
    )
    return _extracted(read_table(spark, sf_dir, "customer"), "c_custkey", html, "title", "author", "published", "site", "image")


def title_without_site(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = _markup("<title>All about {p} and more | {b}</title><body>x</body>", p=F.col("p_partkey"), b=F.col("p_brand"))
    return _extracted(read_table(spark, sf_dir, "part"), "p_partkey", html, "title", "site")


def mini_app(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = _markup(
        """<meta name="fc:frame" content='{"version":"next","imageUrl":"/{k}.png","button":{"title":"Go {k}","action":{"type":"launch_frame","url":"https://a.example/{k}"}}}'>""", k=F.col("s_suppkey")
    )
    found = _extracted(read_table(spark, sf_dir, "supplier"), "s_suppkey", html, "mini_app_embed")
    e = F.col("mini_app_embed")
    return found.select("s_suppkey", e["version"].alias("version"), e["imageUrl"].alias("image_url"), e["button"]["title"].alias("title"), e["button"]["action"]["url"].alias("action_url"))


def clutter_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A long paragraph stays; menu, sidebar, hidden parts, counters and reading time go."""
    html = _markup(
        '<body><nav><ul><li><a href="/">Home</a></li></ul></nav><article><h1>Part {k}</h1><p>4 min read</p><p>{long} {k}</p><p style="display:none">gone</p><div class="sidebar">{n}</div><p>12 likes</p>'
        '<img src="/dot.png" width="9" height="9"><p>{long} end</p></article><footer>bottom</footer></body>',
        k=F.col("p_partkey"), n=F.col("p_name"), long=F.repeat(F.lit("word "), F.lit(120)),
    )
    rows = read_table(spark, sf_dir, "part").select("p_partkey", html.alias("html"), F.lit(None).cast("string").alias("url"))
    return P.extract(rows, Options(separate_markdown=True), keep=("p_partkey",)).select("p_partkey", F.md5("content_markdown").alias("markdown_md5"))


def md_article(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = _markup('<h1>Part {k}</h1><p>Size <b>{s}</b>, <em>brand</em> <code>{b}</code>, see <a href="/p/{k}">more</a>.</p><hr><blockquote><p>a</p><p>{k}</p></blockquote>', k=F.col("p_partkey"), s=F.col("p_size"), b=F.col("p_brand"))
    return _markdown(read_table(spark, sf_dir, "part"), "p_partkey", html)


def md_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = _markup("<ul><li>{k}<ul><li>in {s}</li></ul></li><li><input type=checkbox checked> done</li></ul><ol start=3><li>{s}</li><li>next</li></ol>", k=F.col("p_partkey"), s=F.col("p_size"))
    return _markdown(read_table(spark, sf_dir, "part"), "p_partkey", html)


def md_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = _markup("<table><tr><th>key</th><th>size</th></tr><tr><td>{k}</td><td>{s}</td></tr><tr><td>a|b</td><td></td></tr></table>", k=F.col("p_partkey"), s=F.col("p_size"))
    return _markdown(read_table(spark, sf_dir, "part"), "p_partkey", html)


def md_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = _markup('<div class="highlight"><pre><code class="language-python">x = {k}\nif x:\n    print({s})\n</code></pre></div>', k=F.col("p_partkey"), s=F.col("p_size"))
    return _markdown(read_table(spark, sf_dir, "part"), "p_partkey", html)


def md_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Footnotes, callouts, formulas and images."""
    html = _markup(
        '<p>Text<sup id="fnref:{k}"><a href="#fn:{k}">1</a></sup></p><div class="callout" data-callout="tip"><div class="callout-title"><div class="callout-title-inner">Hint {s}</div></div><div class="callout-content"><p>do</p></div></div>'
        '<math display="block" data-latex="x_{s}"></math><figure><img src="/{k}.png" alt="pic"><figcaption>cap</figcaption></figure><div class="footnotes"><ol><li id="fn:{k}"><p>note {s} <a href="#fnref:{k}">↩</a></p></li></ol></div>',
        k=F.col("p_partkey"), s=F.col("p_size"),
    )
    return _markdown(read_table(spark, sf_dir, "part"), "p_partkey", html)


def text_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain text of a page made of each part."""
    html = _markup("<head><title>t</title></head><h1>Part {k}</h1><p>Size {s}<br>next</p><script>x</script><ul><li>{b}</li><li>two</li></ul>", k=F.col("p_partkey"), s=F.col("p_size"), b=F.col("p_brand"))
    return read_table(spark, sf_dir, "part").select("p_partkey", P.to_text(html).alias("text"))


def hidden_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of three paragraphs, one hidden by style, class or not at all, by key."""
    how = F.element_at(F.array(*map(F.lit, ('style="display:none"', 'class="hidden"', 'class="hidden md:block"', "hidden"))), (F.col("c_custkey") % 4 + 1).cast("int"))
    html = _markup("<body><p>{long}</p><p {how}>secret {k}</p><p>{long} end</p></body>", how=how, k=F.col("c_custkey"), long=F.repeat(F.lit("word "), F.lit(120)))
    found = _extracted(read_table(spark, sf_dir, "customer"), "c_custkey", html, "content", "word_count")
    return found.select("c_custkey", F.contains("content", F.lit("secret")).alias("shown"), "word_count")


# Shapes in which pages write the same thing: each is written for a fifth or so of the suppliers and has to come out alike.
NOTE_FORMS = (
    '<p>Text {k}<sup>1</sup> and<sup>2</sup></p><p class="footnote"><sup>1</sup>First {k}</p><p>middle</p><p class="footnote"><sup>2</sup>Second</p>',
    '<p>Text {k}<sup><a href="#_ftn1">[1]</a></sup> and<sup><a href="#_ftn2">[2]</a></sup></p><p>middle</p><hr><p id="_ftn1">First {k}</p><p id="_ftn2">Second</p>',
    '<p>Text {k}<span class="inline-footnote">1<span class="footnoteContent" style="display:none">First {k}</span></span> and<span class="inline-footnote">2<span class="footnoteContent">Second</span></span></p><p>middle</p>',
    '<p>Text {k}<a href="#ref1">[1]</a> and<a href="#ref2">[2]</a></p><p>middle</p><div class="references"><h3>References</h3><div class="reference"><a id="ref1">1.</a><div>First {k}</div></div><div class="reference"><a id="ref2">2.</a><div>Second</div></div></div>',
    '<p>Text {k}<sup>1</sup> and<sup>2</sup></p><p>middle</p><p><strong>1</strong> First {k}</p><p><strong>2</strong> Second</p>',
    '<p>Text {k}<sup id="fnref:1"><a href="#fn:1">1</a></sup> and<sup id="fnref:2"><a href="#fn:2">2</a></sup></p><p>middle</p><section class="footnotes"><ol><li id="fn:1"><p>First {k} <a href="#fnref:1">↩</a></p></li><li id="fn:2">Second</li></ol></section>',
    '<p>Text {k}<span data-definition="n1"><a href="#">*</a></span> and<span data-definition="n2"><a href="#">*</a></span></p><p>middle</p><aside id="n1" style="display:none">First {k}</aside><aside id="n2" style="display:none">Second</aside>',
)
CODE_FORMS = (
    '<div class="highlight"><pre><span class="lineno">1</span><code class="language-python">x = {k}\nif x:\n    y = x</code></pre></div>',
    '<table class="lntable"><tr><td class="lntd"><pre><code>1\n2\n3\n</code></pre></td><td class="lntd"><pre><code class="language-python" data-lang="python">x = {k}\nif x:\n    y = x\n</code></pre></td></tr></table>',
    '<figure class="highlight python"><table><tr><td class="gutter"><pre><span class="line">1</span><br><span class="line">2</span></pre></td><td class="code"><pre><span class="line">x = {k}</span><br><span class="line">if x:</span><br><span class="line">    y = x</span></pre></td></tr></table></figure>',
    '<pre class="chroma"><code class="language-python"><span class="line"><span style="user-select:none">1</span><span>x = {k}\n</span></span><span class="line"><span style="user-select:none">2</span><span>if x:\n</span></span><span class="line"><span style="user-select:none">3</span><span>    y = x\n</span></span></code></pre>',
    '<pre data-language="python"><code data-language="python"><span data-line="">x = {k}</span>\n<span data-line="">if x:</span>\n<span data-line="">    y = x</span></code></pre>',
    '<pre class="language-python"><div class="cm-editor"><div class="cm-gutters"><div>1</div></div><div class="cm-content"><div class="cm-line">x = {k}</div><div class="cm-line">if x:</div><div class="cm-line">    y = x</div></div></div></pre>',
)
MATH_FORMS = (
    '<p>so <span class="math-inline" data-math="x_{{k}}"><span class="katex"><span class="katex-html">x</span></span></span> holds</p>',
    '<p>so <span class="katex"><span class="katex-mathml"><math><semantics><mi>x</mi><annotation encoding="application/x-tex">x_{{k}}</annotation></semantics></math></span><span class="katex-html">x</span></span> holds</p>',
    "<p>so $x_{{k}}$ holds</p>",
    '<p>so <img src="https://latex.codecogs.com/png?latex=x_{{k}}"> holds</p>',
    '<p>so <math alttext="x_{{k}}"><mi>x</mi></math> holds</p>',
)


def _forms(spark: SparkSession, sf_dir: str, forms: tuple[str, ...]) -> DataFrame:
    """The Markdown of a page for each supplier, in one of the forms by its key."""
    form = F.element_at(F.array(*map(F.lit, forms)), (F.col("s_suppkey") % len(forms) + 1).cast("int"))
    html = _markup("<body><article><p>{long}</p>{form}<p>{long}end</p></article></body>", form=form, k=F.col("s_suppkey"), long=F.repeat(F.lit("word "), F.lit(120)))
    rows = read_table(spark, sf_dir, "supplier").select("s_suppkey", html.alias("html"), F.lit(None).cast("string").alias("url"))
    found = P.extract(rows, Options(separate_markdown=True), keep=("s_suppkey",))
    return found.select("s_suppkey", F.replace("content_markdown", F.repeat(F.lit("word "), F.lit(119))).alias("markdown"))


def note_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _forms(spark, sf_dir, NOTE_FORMS)


def code_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _forms(spark, sf_dir, CODE_FORMS)


def math_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _forms(spark, sf_dir, MATH_FORMS)


def nodes_within_nav(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements within navigation, by an interval join of ancestors."""
    found = P.nodes(read_table(spark, sf_dir, "pages")).select("page_id", "pre", "post", "tag")
    nav = found.where("tag = 'nav'").select("page_id", F.col("pre").alias("nav_pre"), F.col("post").alias("nav_post"))
    inside = found.join(nav, "page_id").where("nav_pre < pre AND nav_post > post AND tag IN ('a', 'li')")
    return inside.groupBy("page_id", "tag").agg(F.count("*").alias("n"))


def _menu_and_title(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(page_id, word) of menu links, which are one word each, and of titles, without repeats."""
    found = P.nodes(read_table(spark, sf_dir, "pages")).select("page_id", "pre", "post", "tag", F.lower("text").alias("text"))
    nav = found.where("tag = 'nav'").select("page_id", F.col("pre").alias("nav_pre"), F.col("post").alias("nav_post"))
    menu = found.where("tag = 'a'").join(nav, "page_id").where("nav_pre < pre AND nav_post > post").select("page_id", F.col("text").alias("word"))
    title = found.where("tag = 'title'").select("page_id", F.explode(F.split("text", " ")).alias("word"))
    return menu.distinct(), title.distinct()


def menu_words_not_in_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    menu, title = _menu_and_title(spark, sf_dir)
    return menu.join(title, ["page_id", "word"], "left_anti")


def menu_words_in_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    menu, title = _menu_and_title(spark, sf_dir)
    return menu.intersect(title)


def scheme_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by scheme and by whether their body ends, with all totals."""
    rows = sources.read_table(spark, sf_dir, "pages")
    rows = rows.select(F.regexp_extract("url", "^([a-z]+):", 1).alias("scheme"), F.contains(F.coalesce("html", F.lit("")), F.lit("</body>")).alias("ended"))
    return rows.cube("scheme", "ended").agg(F.count("*").alias("n_pages"))


def nav_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The links of a menu with the text of the one before and after."""
    links = P.nodes(read_table(spark, sf_dir, "pages")).select("page_id", "pre", "post", "tag", "text")
    nav = links.where("tag = 'nav'").select("page_id", F.col("pre").alias("nav_pre"), F.col("post").alias("nav_post"))
    links = links.where("tag = 'a'").join(nav, "page_id").where("nav_pre < pre AND nav_post > post")
    order = Window.partitionBy("page_id").orderBy("pre")
    return links.select("page_id", (F.row_number().over(order) - 1).cast("long").alias("pos"), F.md5("text").alias("text_md5"), F.md5(F.lag("text").over(order)).alias("before_md5"), F.md5(F.lead("text").over(order)).alias("after_md5"))


def embedded_videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = _markup('<p>a</p><iframe width="5" src="https://www.youtube.com/embed/v{k}?rel=0"></iframe>', k=F.col("p_partkey"))
    return read_table(spark, sf_dir, "part").select("p_partkey", H.embed_links(html).alias("html"))


def placeholders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first value that isn't a leftover of a template."""
    kind = F.col("c_custkey") % 4
    first = F.when(kind == 0, F.lit("{{name}}")).when(kind == 1, F.lit("#author")).when(kind == 2, F.lit(" - ")).otherwise(F.col("c_name"))
    return read_table(spark, sf_dir, "customer").select("c_custkey", H.first_valid(first, F.lit(""), F.col("c_mktsegment")).alias("value"))


def request_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON bodies, some of them unusable, extracted by their own options; what is wrong with the others."""
    k = F.col("c_custkey")
    options = F.when(k % 2 == 0, F.lit('{"markdown":true}')).otherwise(F.lit('{"separate_markdown":true,"markdown":null}'))
    body = F.when(k % 5 == 0, F.lit("{not json")).when(k % 5 == 1, F.lit('{"url":"https://a.example"}')).when(k % 5 == 2, F.lit('{"html":""}'))
    body = body.when(k % 5 == 3, _markup('{"html":"<head><title>{n}</title></head><body><p>x <b>{k}</b></p></body>","url":"https://a.example/{k}","options":{o}}', n=F.col("c_name"), k=k, o=options))
    body = body.otherwise(_markup('{"html":"<title>{n}</title><p>x</p>"}', n=F.col("c_name")))
    rows = parse_requests(read_table(spark, sf_dir, "customer").select("c_custkey", body.alias("value")), keep=("c_custkey",))
    found = P.extract_requests(rows, keep=("c_custkey",))
    in_place = F.when(~F.startswith("content", F.lit("<")), F.col("content"))
    return found.select("c_custkey", "error", "title", "domain", in_place.alias("markdown"), F.col("content_markdown").alias("separate"))


def bbcode(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = _markup("[h1]{k}[/h1][b]bold[/b] [url=https://e.example/{k}]go[/url] [url=javascript:x]no[/url]\n[list][*]{s}[*]b[/list][quote=me]q[/quote][foo]", k=F.col("p_partkey"), s=F.col("p_size"))
    return read_table(spark, sf_dir, "part").select("p_partkey", P.from_bbcode(source).alias("html"))


def conversation_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation as one article: the turns in order, replies one level deeper."""
    turns = read_table(spark, sf_dir, "conversations")
    depth = F.when(F.col("role") == "assistant", 1).otherwise(0)
    message = P.rendered_conversation(F.col("role"), F.col("turn").cast("string"), F.concat(F.lit("<p>"), F.md5(F.coalesce("text", F.lit(""))), F.lit("</p>")), depth)
    each = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", message.alias("html")))).alias("m"))
    return each.select("conv_id", F.md5(F.concat(F.lit('<article class="conversation">'), F.array_join(F.transform("m", lambda x: x["html"]), ""), F.lit("</article>"))).alias("html_md5"))


def chat_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chat page written for each conversation, and its messages read back."""
    turns = read_table(spark, sf_dir, "conversations").where("text IS NOT NULL AND role IS NOT NULL")
    safe = F.replace(F.replace(F.col("text"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    part = F.concat(F.lit('<div data-message-author-role="'), F.col("role"), F.lit('"><p>'), safe, F.lit("</p></div>"))
    chats = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", part.alias("part")))).alias("m"))
    chats = chats.select("conv_id", F.array_join(F.transform("m", lambda x: x["part"]), "").alias("html"), F.lit("https://chatgpt.com/c/1").alias("url"))
    return P.messages(chats, keep=("conv_id",)).select("conv_id", F.col("pos").cast("long").alias("pos"), "author", "depth")


QUERIES = {f.__name__: f for f in (
    extract_full, page_text, dom_nodes, dom_tag_counts, link_density, head_fields, schema_fields, title_without_site, mini_app, clutter_removed,
    note_forms, code_forms, math_forms, nodes_within_nav, menu_words_not_in_title, menu_words_in_title, scheme_cube, nav_neighbours,
    md_article, md_list, md_table, md_code, md_notes, text_fixed, hidden_parts, embedded_videos, placeholders, request_bodies, bbcode, conversation_html, chat_messages,
)}
_NL = "chr(10)"
_PARA = f"{_NL} || {_NL}"
_NAV = r"regexp_extract_all(regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1), '(?s)<a [^>]*>(.*?)</a>', 1)"
# DuckDB text of markup: the pages have four kinds of character references, one of them cut short at times
_UNMARKED = "regexp_replace(replace(replace(replace(regexp_replace(%s, '(?s)<!--.*?-->|<[^>]*>', '', 'g'), '&quot;', '\"'), '&copy;', '©'), '&middot;', '·'), '&amp;?', '&', 'g')"
_MENU = f"SELECT page_id, lower(unnest({_NAV})) AS t FROM pages"
_TITLE = "SELECT page_id, unnest(string_split(lower(replace(replace(regexp_extract(html, '<title>(.*?)</title>', 1), '&lt;', '<'), '&amp;', '&')), ' ')) AS t FROM pages"
ORACLE_SQL = {
    "note_forms": f"""
SELECT s_suppkey, 'word' || {_PARA} || 'Text ' || s_suppkey || '[^1] and[^2]' || {_PARA} || 'middle' || {_PARA} || 'word end' || {_PARA} || '[^1]: First ' || s_suppkey || {_PARA} || '[^2]: Second' AS markdown FROM supplier""",
    "code_forms": f"""
SELECT s_suppkey, 'word' || {_PARA} || '```python' || {_NL} || 'x = ' || s_suppkey || {_NL} || 'if x:' || {_NL} || '    y = x' || {_NL} || '```' || {_PARA} || 'word end' AS markdown FROM supplier""",
    "math_forms": f"SELECT s_suppkey, 'word' || {_PARA} || 'so $x_{{' || s_suppkey || '}}$ holds' || {_PARA} || 'word end' AS markdown FROM supplier",
    "nodes_within_nav": """
SELECT page_id, tag, count(*) AS n FROM (
  SELECT page_id, unnest(regexp_extract_all(regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1), '<(a|li)[ >]', 1)) AS tag FROM pages) GROUP BY ALL""",
    "menu_words_not_in_title": f"SELECT DISTINCT page_id, t AS word FROM ({_MENU}) ANTI JOIN ({_TITLE}) USING (page_id, t)",
    "menu_words_in_title": f"SELECT page_id, t AS word FROM ({_MENU}) INTERSECT SELECT page_id, t FROM ({_TITLE})",
    "scheme_cube": """
SELECT regexp_extract(url, '^([a-z]+):', 1) AS scheme, contains(coalesce(html, ''), '</body>') AS ended, count(*) AS n_pages FROM pages GROUP BY CUBE (1, 2)""",
    "nav_neighbours": f"""
SELECT page_id, i AS pos, md5(l[i + 1]) AS text_md5, md5(l[i]) AS before_md5, md5(l[i + 2]) AS after_md5 FROM (
  SELECT page_id, l, unnest(range(len(l))) AS i FROM (SELECT page_id, {_NAV} AS l FROM pages))""",
    "dom_tag_counts": """
SELECT page_id, tag, count(*) AS n FROM (
  SELECT page_id, unnest(regexp_extract_all(regexp_replace(html, '(?s)<script>.*?</script>', '<script>', 'g'), '<(a|li|nav|article|footer|h1|div|script|style|title)[ >]', 1)) AS tag FROM pages) GROUP BY ALL""",
    "page_text": r"""
SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(t, ' *' || chr(10) || ' *', chr(10), 'g'), chr(10) || '{3,}', chr(10) || chr(10), 'g'), ' +', ' ', 'g'), ' ' || chr(10)) AS text FROM (
  SELECT page_id, regexp_replace(replace(replace(replace(regexp_replace(b, '<[^>]*>', '', 'g'), '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&amp;?', '&', 'g') AS t FROM (
    SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
      regexp_extract(html, '(?s)<body>(.*)', 1), '(?s)<!--.*?-->|</p>', '', 'g'), '\s+', ' ', 'g'), '<li>', chr(10) || '• ', 'g'), '<h1>|<p>|</article>', chr(10) || chr(10), 'g'),
      '<div[^>]*>|</div>|<article>|</h1>|<br>', chr(10), 'g') AS b FROM pages))""",
    "link_density": f"""
SELECT page_id, text_bytes, link_bytes, link_bytes / text_bytes AS density FROM (
  SELECT page_id, strlen({_UNMARKED % "body"})::BIGINT AS text_bytes, strlen({_UNMARKED % "links"})::BIGINT AS link_bytes FROM (
    SELECT page_id, body, array_to_string(regexp_extract_all(body, '(?s)<a [^>]*>(.*?)</a>', 1), '') AS links FROM (
      SELECT page_id, regexp_extract(html, '(?s)<body>(.*)', 1) AS body FROM pages)))""",
    "head_fields": """
SELECT c_custkey, c_name AS title, c_name AS author, 'about ' || c_name AS description, c_mktsegment AS site, c_custkey::VARCHAR AS published, '/i/' || c_custkey || '.png' AS image, '/f' || c_custkey || '.ico' AS favicon, 'news.example' AS domain FROM customer""",
    "schema_fields": "SELECT c_custkey, c_name AS title, c_name || ', ' || c_mktsegment AS author, c_custkey::VARCHAR AS published, c_mktsegment AS site, '/' || c_custkey || '.jpg' AS image FROM customer",
    "title_without_site": "SELECT p_partkey, 'All about ' || p_partkey || ' and more' AS title, p_brand AS site FROM part",
    "mini_app": "SELECT s_suppkey, 'next' AS version, '/' || s_suppkey || '.png' AS image_url, 'Go ' || s_suppkey AS title, 'https://a.example/' || s_suppkey AS action_url FROM supplier",
    "clutter_removed": f"SELECT p_partkey, md5('## Part ' || p_partkey || {_NL} || {_NL} || repeat('word ', 120) || p_partkey || {_NL} || {_NL} || repeat('word ', 120) || 'end') AS markdown_md5 FROM part",
    "md_article": f"SELECT p_partkey, '## Part ' || p_partkey || {_NL} || {_NL} || 'Size **' || p_size || '**, *brand* `' || p_brand || '`, see [more](/p/' || p_partkey || ').' || {_NL} || {_NL} || '---' || {_NL} || {_NL} || '> a' || {_NL} || '>' || {_NL} || '> ' || p_partkey AS markdown FROM part",
    "md_list": f"SELECT p_partkey, '- ' || p_partkey || {_NL} || chr(9) || '- in ' || p_size || {_NL} || '- [x] done' || {_NL} || {_NL} || '3. ' || p_size || {_NL} || '4. next' AS markdown FROM part",
    "md_table": f"SELECT p_partkey, '| key | size |' || {_NL} || '| --- | --- |' || {_NL} || '| ' || p_partkey || ' | ' || p_size || ' |' || {_NL} || '| a\\|b |  |' AS markdown FROM part",
    "md_code": f"SELECT p_partkey, '```python' || {_NL} || 'x = ' || p_partkey || {_NL} || 'if x:' || {_NL} || '    print(' || p_size || ')' || {_NL} || '```' AS markdown FROM part",
    "md_notes": f"""
SELECT p_partkey, concat_ws({_NL} || {_NL}, 'Text[^' || p_partkey || ']', '> [!tip] Hint ' || p_size || {_NL} || '> do', '$$' || {_NL} || 'x_' || p_size || {_NL} || '$$', '![pic](/' || p_partkey || '.png)', 'cap', '[^' || p_partkey || ']: note ' || p_size) AS markdown FROM part""",
    "text_fixed": f"SELECT p_partkey, 'Part ' || p_partkey || {_NL} || {_NL} || 'Size ' || p_size || {_NL} || 'next' || {_NL} || {_NL} || '• ' || p_brand || {_NL} || '• two' AS text FROM part",
    "hidden_parts": "SELECT c_custkey, c_custkey % 4 >= 2 AS shown, (241 + CASE WHEN c_custkey % 4 >= 2 THEN 2 ELSE 0 END)::BIGINT AS word_count FROM customer",
    "embedded_videos": """SELECT p_partkey, '<p>a</p><a href="https://www.youtube.com/watch?v=v' || p_partkey || '">YouTube: v' || p_partkey || '</a>' AS html FROM part""",
    "placeholders": "SELECT c_custkey, CASE WHEN c_custkey % 4 = 3 THEN c_name ELSE c_mktsegment END AS value FROM customer",
    "request_bodies": """
SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'html is missing or no string' WHEN 1 THEN 'html is missing or no string' WHEN 2 THEN 'html is empty' END AS error,
  CASE WHEN c_custkey % 5 >= 3 THEN c_name END AS title, CASE c_custkey % 5 WHEN 3 THEN 'a.example' WHEN 4 THEN '' END AS domain,
  CASE WHEN c_custkey % 10 = 8 THEN 'x **' || c_custkey || '**' END AS markdown, CASE WHEN c_custkey % 10 = 3 THEN 'x **' || c_custkey || '**' END AS separate FROM customer""",
    "bbcode": """
SELECT p_partkey, '<h1>' || p_partkey || '</h1><strong>bold</strong> <a href="https://e.example/' || p_partkey || '">go</a> no<br><ul><li>' || p_size || '</li><li>b</li></ul><blockquote>q</blockquote>' AS html FROM part""",
    "conversation_html": """
SELECT conv_id, md5('<article class="conversation">' || string_agg(h, '' ORDER BY turn, role) || '</article>') AS html_md5 FROM (
  SELECT conv_id, turn, role, repeat('<blockquote>', (role = 'assistant')::INT) || '<div class="conversation-message"><p class="conversation-author"><strong>' || role || '</strong></p><p class="conversation-timestamp"><em>' || turn || '</em></p><p>'
    || md5(coalesce(text, '')) || '</p></div>' || repeat('</blockquote>', (role = 'assistant')::INT) AS h FROM conversations) GROUP BY conv_id""",
    "chat_messages": """
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, CASE role WHEN 'user' THEN 'You' WHEN 'assistant' THEN 'ChatGPT' WHEN 'system' THEN 'System' ELSE role END AS author, 0::INTEGER AS depth
FROM conversations WHERE text IS NOT NULL AND role IS NOT NULL""",
}
