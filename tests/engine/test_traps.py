"""Behaviour that is easily got wrong, one test for each point, and pages that are out of the ordinary."""

import time

import pytest

from pagequern.extract import cleanup, standardize
from pagequern.extract.head import Head, clean_title, collect, schema_value
from pagequern.extract.markdown import html_to_markdown, image_source
from pagequern.extract.options import Options
from pagequern.extract.page import extract
from pagequern.extract.text import count_words, html_to_text
from pagequern.html.dom import DEEPEST, body_of, fragment, inner_html, parse, serialize

LONG = "<p>" + "word " * 210 + "</p>"


def content(html, **options):
    return extract(f"<body>{LONG}{html}</body>", options=Options(**options))["content"]


def test_either_flag_runs_the_removal_by_name_over_the_tree():
    aside = '<table class="sidebar-content"><tr><td>side</td><td>x</td></tr><tr><td>a</td><td>b</td></tr></table>'
    assert "side<" not in content(aside) and "side<" not in content(aside, remove_partial_selectors=False)
    assert "side<" in content(aside, remove_exact_selectors=False, remove_partial_selectors=False)


def test_second_reading_keeps_clutter_but_not_patterns():
    html = "<body><footer>foot</footer><p>12 likes</p><p>" + "few " * 20 + "</p></body>"
    got = extract(html)["content"]
    assert "foot" in got and "likes" not in got


def test_second_reading_is_of_the_page_and_not_of_the_site():
    got = extract('<div data-message-author-role="user">hi</div>', "https://chatgpt.com/c/1")
    assert got["extractor_type"] == "chatgpt" and got["word_count"] == count_words(got["content"])


def test_words_of_the_general_way_are_of_the_whole_document():
    got = extract(f"<body>{LONG}</body>")
    assert got["content"].startswith("<html><head></head><body>") and got["word_count"] == count_words(got["content"]) == 210


def test_images_in_noscript_survive_the_removal_of_noscript():
    assert 'src="/big.png"' in content('<noscript><img src="/big.png" width="400" height="300"></noscript>')


def test_an_aside_is_removed_before_it_can_become_a_callout():
    aside = '<aside class="callout-note"><p>noted</p></aside>'
    assert "noted" not in content(aside)
    assert 'data-callout="note"' in content(aside, remove_exact_selectors=False, remove_partial_selectors=False)


def test_debug_keeps_empty_blocks_and_wrappers():
    html = "<div><div><p>x</p></div></div><p></p>"
    assert standardize.plain_wrappers(html, False) == "<p>x</p>" and standardize.plain_wrappers(html, True) == html


def test_an_unclosed_element_that_is_removed_goes_to_its_parents_end():
    got = content("<div><p>a</p><footer>b<p>c</p></div><p>after</p>")
    assert "<p>after</p>" in got and "<p>c</p>" not in got


def test_three_ways_to_pick_from_a_srcset():
    assert standardize.best_of_srcset("/a.png 900w, /b.png 1x") == "/b.png"
    picture = body_of(parse('<picture><source srcset="/first.png 1x, /second.png 2x"><img></picture>'))
    standardize.images(picture)
    assert picture.first("img").attrs["src"] == "/first.png"
    assert image_source(fragment('<img src="/s.png" srcset="/a.png 100w, /b.png 300w">')[0]) == "/b.png"


def test_names_of_notes_end_at_a_dash_in_reference_and_definition():
    html = '<p>x<sup id="fnref:a-1"><a href="#fn:a-1">1</a></sup></p><div class="footnotes"><ol><li id="fn:a-1"><p>note</p></li></ol></div>'
    assert html_to_markdown(html) == "x[^a]\n\n[^a]: note"


def test_permalinks_by_sign_and_by_class():
    for html in ('<h2>T<a href="#t">¶</a></h2><p>x</p>', '<h2>T<a class="anchor" href="#t">&nbsp;#</a></h2><p>x</p>'):
        root = parse(html)
        standardize.headings(root)
        assert inner_html(body_of(root)) == "<h2>T</h2><p>x</p>"
    root = parse('<h2><a href="#t">A title</a></h2><p>x</p>')
    standardize.headings(root)
    assert "A title" in serialize(root)


def test_site_of_schema_is_a_key_and_not_a_type():
    typed = [{"@type": "WebSite", "name": "by type"}]
    assert schema_value(typed, "WebSite.name") == "" and schema_value([{"WebSite": {"name": "by key"}}], "WebSite.name") == "by key"


def test_body_without_an_end_is_the_whole_page():
    assert "A title" in extract(f"<html><head><title>A title</title></head><body>{LONG}")["content"]


def test_white_space_is_that_of_unicode_in_words_and_lengths_are_bytes():
    assert count_words("a b c") == 3
    assert cleanup.link_share(body_of(parse("<a href=x>éé</a>abcd"))) == 0.5


def test_json_ld_arrays_and_last_title():
    head = collect(parse('<title>a</title><script type="application/ld+json">[1, {"x": 2}]</script><svg><title>b</title></svg>'))
    assert head.schema == [[1, {"x": 2}]] and head.title == "b"
    assert Head().of("n:author") == ""


@pytest.mark.parametrize(
    ("title", "site", "want"),
    [
        ("A long story | News", "", ("A long story", "News")),
        ("News | A long story", "", ("A long story", "News")),
        ("A long story - Daily News", "", ("A long story", "Daily News")),
        ("Daily News - A long story", "", ("Daily News - A long story", "")),
        ("One | Two three four five", "", ("Two three four five", "One")),
        ("Story of x — Tech — The Daily News", "The Daily News", ("Story of x — Tech", "The Daily News")),
        ("The Daily News: a story", "The Daily News", ("The Daily News: a story", "")),
        ("Story here today | Tech | Daily", "The Daily News", ("Story here today", "The Daily News")),
        ("Daily | Tech | Story here today", "The Daily News", ("Story here today", "The Daily News")),
        ("The Daily News", "The Daily News", ("The Daily News", "")),
        ("a-b and c", "", ("a-b and c", "")),
    ],
)
def test_titles_without_their_site(title, site, want):
    assert clean_title(title, site) == want


@pytest.mark.parametrize("tag", ["div", "blockquote", "b", "ul><li", "span", "table><tr><td"])
def test_deep_pages_are_read(tag):
    html = "".join(f"<{tag}>" for _ in range(3000)) + "text here"
    began = time.monotonic()
    assert "text here" in html_to_text(html) and "text here" in html_to_markdown(html)
    if tag in ("div", "b"):
        assert "text here" in extract(html)["content"]
    assert time.monotonic() - began < 60
    assert max(sum(1 for _ in n.up()) for n in parse(html).walk()) <= DEEPEST + 4


def test_what_is_too_deep_stays_in_order():
    html = "".join(f"<div>{i} " for i in range(1000))
    assert html_to_text(html).split() == [str(i) for i in range(1000)]
