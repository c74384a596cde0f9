"""Golden tests of the clean-up of Markdown with HTML left in it."""

from __future__ import annotations

import pytest

from pagelake.operators.residual import (
    absolute_targets, clean_html_residue, clean_residual, clean_text, drop_bloating_tables, drop_escapes, halve_link_text, join_link_lines, limit_item_runs, thin_out_tables,
)


@pytest.mark.parametrize(
    "text, want",
    [
        (None, None),
        ("", ""),
        ("plain & simple", "plain & simple"),
        ("a &amp;lt; b &copy;", "a < b ©"),
        ("<p>One</p><p>Two</p>", "\nOne\n\nTwo\n"),
        ("Some <em>fine</em> and <strong>bold</strong> words<br/>next", "Some _fine_ and **bold** words\nnext"),
        ('See <a href="/x">the <b>page</b></a>.', "See [the **page**](/x)."),
        ('<a href="javascript:go()">go</a> <a>none</a>', "go none"),
        ('<img alt="A" src="/a.png"> <img alt="B">', "![A](/a.png) "),
        ("Use `<div>` and\n```\n<p>&amp;</p>\n```", "Use `<div>` and\n```\n<p>&amp;</p>\n```"),
        ('<pre><code class="language-rust">fn a() -&gt; u8 {\n    1\n}</code></pre>', "\n```rust\nfn a() -> u8 {\n    1\n}\n```\n"),
        ("<pre>bare</pre><pre> </pre>", "\n```\nbare\n```\n"),
        ("The <title> element and <my-x> stay", "The `<title>` element and  stay"),
        ("[<head>](/head) is", "[`<head>`](/head) is"),
        ("<ul><li>a</li><li>b</li></ul>", "\n- a\n- b\n\n"),
        ("x<script>if (a < b) { c() }</script>y<!-- no -->z<![CDATA[q]]>", "xyz"),
        ('<div class="k">in</div><custom data-x="1">y', "iny"),
        ("<table><tr><th>A</th><td>1</td></tr></table>", "\n\n | A |  1 \n\n"),
        ("1 < 2 and 3 > 2", "1 < 2 and 3 > 2"),
    ],
)
def test_html_residue(text, want):
    assert clean_html_residue(text) == want


def test_small_steps():
    assert drop_escapes(r"a\<b\> c\ d :root{--x: 1}e") == "a c d e"
    assert halve_link_text("[HP HP](/h) [a b a b](/x) [a b c](/y)") == "[HP](/h) [a b](/x) [a b c](/y)"
    assert limit_item_runs("* a\n\n* a\n* a\n- b\n* a") == "* a\n\n* a\n- b\n* a"
    assert limit_item_runs("* a\ntext\n* a\n* a\n* a") == "* a\ntext\n* a\n* a"
    assert join_link_lines("[\nRuby\n[x\ny]\n](/r)\nend") == "[ Ruby [x y] ](/r)\nend"
    base = "https://a.example/docs/x"
    assert absolute_targets("[a](/b) ![c](d.png) [e](#f) ![g](data:x) [h](//i.example/j) [k](https://l.example)", base) == (
        "[a](https://a.example/b) ![c](https://a.example/docs/d.png) [e](#f) ![g](data:x) [h](https://i.example/j) [k](https://l.example)"
    )


def test_code_keeps_its_lines():
    code = "```\n* a\n* a\n* a\n[HP HP](x)\n```"
    assert clean_text(code) == code
    assert clean_text("`[HP HP](x)` [HP HP](x)") == "`[HP HP](x)` [HP](x)"


def test_heavy_tables():
    rows = "<tr><td>cell of some text</td></tr>"
    layout = "<table>" + rows * 2000 + "</table>"
    data = '<table class="wikitable">' + rows * 40 + "</table>"
    page = f"<body>{layout}{data}</body>"
    assert "<td>" in thin_out_tables(page) and thin_out_tables(page).count("<table") == 1
    assert thin_out_tables(layout[:1000]) == layout[:1000]
    prose = "<p>" + "word " * 40_000 + "</p>"
    assert thin_out_tables(prose + data) == prose + data
    assert drop_bloating_tables(page, "x" * 4 * len(page)) == f"<body>{data}</body>"
    assert drop_bloating_tables(page, "x" * len(page)) is None and drop_bloating_tables("<p>", "x" * 100) is None


def test_over_a_table(spark):
    df = spark.createDataFrame([(1, "<b>x</b> [a a](/b)", "https://a.example/"), (2, None, None), (3, "", None), (4, "<p>" * 20_000, None)], "id LONG, t STRING, url STRING")
    got = {r.row_id: r.markdown for r in clean_residual(df, "id", "t", "url").collect()}
    assert got[1] == "**x** [a](https://a.example/b)" and got[2] is None and got[3] == "" and got[4].strip() == ""
    assert clean_residual(df.limit(0), "id", "t").count() == 0
