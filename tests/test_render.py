"""HTML tree, selectors, rendering and extraction: pure functions."""

from __future__ import annotations

import pytest

from pagelake.operators import render as R
from pagelake.operators.htmltree import SelectorError, compile_selector, parse, select, select_first
from pagelake.operators.robots import is_allowed


def test_implied_end_tags():
    t = parse("<ul><li>one<li>two <b>x</ul><p>a<p>b<div>c</div><table><tr><td>1<td>2<tr><td>3</table>")
    assert [e.text().strip() for e in select(t, "li")] == ["one", "two x"]
    assert [e.text() for e in select(t, "p")] == ["a", "b"]
    assert [[c.text() for c in r.elements()] for r in select(t, "tr")] == [["1", "2"], ["3"]]


def test_raw_text_and_entities():
    t = parse("<script>if (a < b) '</p>'</script><p>x &amp; y &lt;z&gt;</p><!-- <p>no</p> --><br/><img src='a.png' alt=q>")
    assert len(select(t, "p")) == 1 and select_first(t, "p").text() == "x & y <z>" and select_first(t, "img").attrs == {"src": "a.png", "alt": "q"}


@pytest.mark.parametrize(
    ("selector", "n"),
    [("div", 2), (".a", 1), ("#i", 1), ("div.a > span", 1), ("div span", 2), ("[data-x]", 1), ("[data-x='1']", 1), ("[class*='b']", 1), ("[data-x^='2']", 0), ("span:first-child", 2), ("div:not(.a)", 1), ("p, span", 2), ("[role=MAIN i]", 1)],
)
def test_selectors(selector, n):
    t = parse("<div class='a b' id=i data-x=1><span>x</span></div><div role=main><em><span>y</span></em></div>")
    assert len(select(t, selector)) == n


def test_bad_selectors():
    for s in ("", ">", "a[", "::before", "a:hover"):
        with pytest.raises(SelectorError):
            compile_selector(s)


def test_markdown():
    html = """<html><head><title>T</title></head><body><nav><a href="/n">nav</a></nav><main><article><h1>Head</h1><p>One <strong>bold</strong> and <em>soft</em>,
    <a href="/x">link</a>.<br>Next</p><ul><li>a<ul><li>b</li></ul></li><li>c</li></ul><ol><li>x</li></ol><pre><code class="language-py">def f():
    pass</code></pre><blockquote><p>q</p></blockquote><table><thead><tr><th>A</th><th>B</th></tr></thead><tr><td>1</td><td>2</td></tr></table><img src="i.png" alt="pic"></article></main><footer>foot</footer></body></html>"""
    md = R.to_markdown(html, "https://a.example/p/")
    assert md.startswith("# Head") and "**bold**" in md and "*soft*" in md and "[link](https://a.example/x)" in md
    assert "* a\n  * b\n* c" in md and "1. x" in md and "```py\ndef f():\n    pass\n```" in md and "> q" in md
    assert "| A | B |\n| --- | --- |\n| 1 | 2 |" in md and "![pic](https://a.example/p/i.png)" in md
    assert "nav" not in md and "foot" not in md
    assert "foot" in R.to_markdown(html, only_main=False)


def test_special_bodies():
    assert R.to_markdown('{"a": 1}').startswith("# JSON Response") and R.to_markdown("just text") == "just text" and R.to_markdown(None) is None and R.to_markdown("") == ""
    assert R.to_markdown("<html><head><title>Only</title></head><body><p>some words</p></body></html>") == "# Only\n\nsome words"


def test_images():
    assert R.srcset_largest("a 1x, b 3x") == "b" and R.srcset_largest("") is None
    html = "<article><h1>x</h1><picture><source srcset='s.jpg 100w, l.jpg 900w'><img src='d.jpg'></picture><img data-src='z.jpg' src='data:image/gif;base64,AA'><noscript><img src='n.jpg'></noscript><video poster='v.jpg'></video></article>"
    md = R.to_markdown(html)
    for name in ("l.jpg", "z.jpg", "n.jpg", "v.jpg"):
        assert f"({name})" in md
    assert R.images("<img src='data:x'><img src='a.png'>", "https://h.example/") == ["https://h.example/a.png"]


def test_layout_tables_and_tags():
    assert "|" not in R.to_markdown("<article><h1>x</h1><table cellpadding=0><tr><td>a</td><td>b</td></tr></table></article>")
    assert R.to_markdown("<div class=k><p>keep this text, which is long enough to stay on its own</p><i>drop</i></div><p>other</p>", include=[".k"], exclude=["i"]) == "keep this text, which is long enough to stay on its own"


def test_metadata_and_quality():
    m = R.metadata("<html lang=fr><title> x </title><meta property='og:description' content='o'><p>" + "long words here " * 10 + "</p>")
    assert m["title"] == "x" and m["language"] == "fr" and m["description"] == "o"
    assert R.metadata("<p>" + "long words here " * 20)["description"].endswith("...")
    total, main, ratio = R.content_quality("<body><nav>12345</nav><p>1234567890</p><script>zzz</script></body>")
    assert (total, main) == (15, 10) and abs(ratio - 1 / 3) < 1e-9
    assert R.content_quality(None) == (0, 0, 0.0)


def test_extraction():
    html = "<div class=p><h3>Phone</h3><b class=c>$999.99</b><i>yes</i><li>1</li><li>2</li><meta content='m'></div>"
    got = R.extract(html, {"n": "h3", "c": ".c", "b": "i", "l": "li", "x": ".none", "m": "meta"}, {"properties": {"c": {"type": "number"}, "b": {"type": "boolean"}, "l": {"type": "array", "items": {"type": "integer"}}}})
    assert got == {"n": "Phone", "c": 999.99, "b": True, "l": [1.0, 2.0], "x": None, "m": "m"}
    assert R.completeness(got) == 5 / 6 and R.completeness({}) == 0.0
    assert R.tables("<table><tr><td>a</td><td>b</td></tr></table>")[0] == (["Column 1", "Column 2"], [{"Column 1": "a", "Column 2": "b"}])


def test_pagination():
    html = '<a rel="next" href="?page=3">x</a><a href="?page=4">4</a><a href="?page=1">1</a><a class="next-link" href="/q">more</a>'
    assert set(R.pagination_links(html, "https://a.example/l?page=2")) == {"https://a.example/l?page=3", "https://a.example/l?page=4", "https://a.example/q"}
    base = "https://a.example/l?page=2"
    for last in ('<a class="next disabled">x</a>', '<button class="next" disabled>Next</button>', '<a aria-label="Go to next page" aria-disabled="true" href="?page=3">3</a>', '<li class="pager-next disabled"></li>', '<a rel="next" disabled href="/x">n</a>'):
        assert R.pagination_links(last, base) == [], last
    plain = "https://a.example/list"
    assert R.pagination_links('<a href="/list?page=2">Next &rarr;</a><a href="#">next</a><a href="javascript:next()">next</a>', plain) == ["https://a.example/list?page=2"]
    assert R.pagination_links('<a href="/list?page=2"> 2 </a><a href="/list?page=3">3</a><a href="/x">2b</a>', plain) == ["https://a.example/list?page=2", "https://a.example/list?page=3"]
    assert R.pagination_links('<link rel="next" href="/page/5/"><a rel="next" href="/page/6/">x</a>', "https://a.example/page/4/") == ["https://a.example/page/5/"]
    assert R.pagination_links('<a class="next" href="?page=1">back</a>', base) == ["https://a.example/l?page=3"] and R.pagination_links("", plain) == []


def test_search_results():
    html = '<div class="result"><a class="result__a" href="//d.example/l/?uddg=https%3A%2F%2Fa.example%2F">T</a><span class="result__snippet">S</span></div><div class="result"><a class="result__a" href="/ad">A</a></div>'
    assert R.search_results(html) == [("T", "https://a.example/", "S")]


def test_robots_rules():
    txt = "User-agent: *\nDisallow: /private/\nAllow: /private/open\n\nUser-agent: GoodBot\nDisallow:\n\nUser-agent: Bad\nDisallow: /\n"
    assert not is_allowed(txt, "/private/x") and is_allowed(txt, "/private/open/1") and is_allowed(txt, "/private/x", "GoodBot/2") and not is_allowed(txt, "/", "bad") and is_allowed(None, "/x")
    assert not is_allowed("User-agent: *\nDisallow: /*.pdf$", "/a.pdf") and is_allowed("User-agent: *\nDisallow: /*.pdf$", "/a.pdfx")


@pytest.mark.parametrize("html", ["", "<", "<p", "</p></div>", "<p>" * 3000, "<table><tr><td>" * 300, "<div>" * 5000 + "x", "<ul><li>" * 2000, "<b>" * 3000, "a" * 100_000, "<a href='" + "x" * 5000, "\x00<b>"])
def test_odd_pages(html):
    R.to_markdown(html)
    R.metadata(html)
    R.tables(html)
    R.content_quality(html)


def test_article_by_scores():
    from pagelake.operators.htmltree import parse
    from pagelake.operators.readability import article

    prose = "The bridge was measured by hand, compared with the plan, and found to be safe, which pleased the town."
    menu = "<nav><ul>" + "".join(f"<li><a href='/{k}'>A long entry of the menu number {k}</a></li>" for k in range(20)) + "</ul></nav>"
    side = f"<div class='sidebar'><p>{prose}</p></div>"
    page = f"<body>{menu}{side}<div class='wrap'><div class='post-content'><h2>Bridge</h2>" + f"<p>{prose}</p>" * 5 + "</div></div><footer><p>" + prose + "</p></footer></body>"
    got = article(parse(page))
    text = " ".join(e.text() for e in got)
    assert text.count("measured") == 5 and "menu" not in text
    assert article(parse("<p>short</p>")) == [] and article(parse("")) == []
