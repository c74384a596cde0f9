"""Block rules, profiles and endings: pure functions."""

from __future__ import annotations

import random
import re

import pytest

from pagelake.llm.language import blocks, label_of
from pagelake.llm.lines import html_kinds, main_body, main_flags
from pagelake.llm.markup import MARKDOWN, clean_markdown, html_findings, leftovers, parse, structured, visible, without_code
from pagelake.llm.profile import profile, quality_kind
from pagelake.llm.residue import SHORT, fit, passages, tokens, trusted_kind
from pagelake.llm.truncation import CLOSED, FORM, MARKED, OPEN, PLAIN, SURE, ending, lengths

PROSE = "The team measured every part of the bridge by hand and then compared it with the plan. It was the first time that this was done."


def body(md: str) -> list[str]:
    lines, _, flags = main_body(md)
    return [x for x, f in zip(lines, flags, strict=True) if f]


def test_main_body_of_a_page():
    md = f"- [Home](https://a.example/le)\n- [Help](https://a.example/lf)\n\nHome > Help > Bridges\n\nWe use cookies to measure visits. [Accept all](#ok)\n\n# Bridges\n\nBy Ada Stone\n\n{PROSE}\n\n* stone\n* wood\n\nShare this page with a friend\n\n## You may also like\n\n- [Tunnels](https://a.example/t)\n\n© 2024 A Site. All rights reserved."
    assert body(md) == ["# Bridges", PROSE, "* stone", "* wood"]


def test_link_list_after_its_heading_is_main_body():
    md = "# Links\n\n- [a b](https://x.example/1)\n- [c d](https://x.example/2)\n- [e f](https://x.example/3)"
    assert len(body(md)) == 4


def test_short_message_without_heading_is_main_body():
    md = "Home\nHelp\nContact\n\n403 Forbidden\n\nYou don't have permission to open this resource."
    assert body(md) == ["403 Forbidden", "You don't have permission to open this resource."]


def test_code_stays_even_with_cue_words():
    md = f"# T\n\n{PROSE}\n\n```text\ncookies\nAdvertisement\n```"
    assert "Advertisement" in body(md)


def test_html_counts_only_body_lines_with_text():
    source = "<html><head><title>Cookies</title></head>\n<body>\n<!-- we use\ncookies -->\n<div>\n<p>Home &gt; Help &gt; X</p>\n</div>\n<h1>X</h1>\n<p>" + PROSE + "</p>\n<script>\nvar a = 1;\n</script>\n<p>Advertisement</p>\n</body></html>"
    _, kinds = html_kinds(source)
    flags = main_flags(kinds)
    assert len(flags) == source.count("\n") + 1
    assert [i for i, f in enumerate(flags) if f is False] == [5, 12]
    assert [i for i, f in enumerate(flags) if f] == [7, 8]


@pytest.mark.parametrize("text", ["", " ", "\n\n", "x", "#", "```", "- ", "|", "\x00", "a" * 300_000, "# \n" * 50_000, "<" * 5000, "<body>" + "<div>" * 5000 + "x", "<ul><li>" * 3000, "<!--" * 30_000, "<script>" * 20_000, "<p " * 20_000, "[" * 20_000, "![" * 10_000, "{{" * 20_000, "$" * 20_000, "''" * 20_000, "`" * 20_001, "** " * 10_000, "\\begin{" * 5000])
def test_odd_texts_do_not_crash(text):
    main_body(text)
    main_flags(html_kinds(text)[1])
    profile(text)
    ending(text)
    lengths(text)
    leftovers(without_code(text))
    clean_markdown(text)
    html_findings(text)
    blocks(text)


@pytest.mark.parametrize(
    ("text", "marks"),
    [
        ("a <b>bold</b> word", ["html"]),
        ("a&nbsp;b", ["html"]),
        ("<!-- note --> text", ["html"]),
        ("See <https://a.example/x> now", []),
        ("The test a < b and b > 3 holds", []),
        ("`<b>` in code", []),
        ("```html\n<p>{{ x.y }}</p>\n```", []),
        ("[[Bridge|bridges]] and '''bold'''", ["wiki"]),
        ("{{Infobox\n| name = x\n}}", ["wiki"]),
        ("== History ==", ["wiki"]),
        ("It costs $4 and saves about $37 a year.", []),
        ("$E = m c^{2}$", ["latex"]),
        ("\\begin{itemize}\n\\item x\n\\end{itemize}", ["latex"]),
        ("R&D and C&A", []),
    ],
)
def test_leftover_markup(text, marks):
    assert leftovers(without_code(text)) == marks


def test_markdown_shown_by_html():
    found, content = html_findings("<body><div><h1>T</h1><p>" + PROSE + "</p><p>**bold words** and [x](/y)</p><pre>**no**</pre></div></body>")
    assert found == ["markdown"]
    assert not MARKDOWN.search("\n".join(map(visible, html_findings("<body><p>" + PROSE + "</p><pre>## no</pre></body>")[1])))
    assert "# T" in structured(content) and "bold words" in structured(content)
    assert "html" in html_findings("<body><p>" + PROSE + " &lt;em&gt;x&lt;/em&gt;</p></body>")[0]


def test_clean_markdown_keeps_structure():
    md = "== Old ==\n\n<ul><li>one</li><li>two</li></ul>\n\n$$x^2$$\n\n```\n<b>kept</b>\n```\n\n| a | b |\n| --- | --- |\n| 1 | 2 |\n\n[[A|b]] &amp; <em>c</em>"
    out = clean_markdown(md)
    assert "## Old" in out and "- one" in out and "$$x^2$$" in out and "<b>kept</b>" in out and "| 1 | 2 |" in out
    assert out.endswith("b & c")


@pytest.mark.parametrize(
    ("text", "kind"),
    [
        ("# T\n\n" + "\n".join(f"- pipes ({i})" for i in range(12)), "list"),
        ("# T\n\n" + "\n".join("1.5;2.25;3.75" for _ in range(12)), "table"),
        ("# T\n\n" + "\n".join(f"stone bridge\t{i}17\t22{i}\t9" for i in range(9)), "table"),
        ("# T\n\n" + "\n\n".join("x7Kp2+Qz9/Lm3TqR8vWn5YbC1dFg4HjK6sXaZ0e" for _ in range(5)), "junk"),
        ("# T\n\n" + "\n\n".join("?! @; ::/ ^& ~~ !, .; %%" for _ in range(5)), "junk"),
        (f"# T\n\n{PROSE}\n\n{PROSE}\n\n- one\n- two", None),
        ("# T", None),
    ],
)
def test_quality_kind(text, kind):
    assert quality_kind(profile(text))[0] == kind


def test_residue_model_from_seeds_alone():
    real = [(0, [f"# Bridge {i}", PROSE, "The canal opens at nine and closes once the market is full."]) for i in range(40)]
    m = fit(real)
    assert m.kind(profile("# 404 Not Found\n\nThe requested address was not found on this server")) == "error_page"
    assert m.kind(profile("Please enable JavaScript to view this page.")) == "script_notice"
    assert m.kind(profile("# {{ page.title }}\n\nDear ${user.name}, your <%= item %> is ready on __ORDER_DATE__.")) == "placeholder"
    assert m.kind(profile("# asdf\n\n" + "blah " * 30)) == "filler"
    assert m.kind(profile(f"# What a 404 page should say\n\n{PROSE} {PROSE}\n\nPlease enable JavaScript to see the comments (3).")) is None
    assert m.kind(profile("")) is None
    assert trusted_kind(profile("# 403 Forbidden"), 403) == 3
    assert trusted_kind(profile("# 403 Forbidden"), None) == SHORT
    assert trusted_kind(profile("Scripts must be on"), 503) == 4
    assert tokens("Ray 0123456789abcdef") == ["ray", "§hex"]


@pytest.mark.parametrize(
    ("text", "kind"),
    [
        ("It was done. It was go", OPEN), ("It was done.", CLOSED), ("It was done.  \n", CLOSED), ("He said \"never.\"", CLOSED), ("kept at home, i.e.", OPEN),
        ("First one. The next is the…", SURE), ("First. And then (more)", SURE), ("Text.\n\nNobody ever found out what happened next…", MARKED), ("- stone bridge", PLAIN),
        ("| a | b |\n| 1 | 2 |", CLOSED), ("| a | b |\n| 1 |", OPEN), ("| a | b |\n| 1", OPEN), ("```\ncode\n```", CLOSED), ("```\ncode", OPEN), ("[a b](https://x.example/y).", CLOSED),
        ("see [a b](https://x.exa", OPEN), ("Text.\n\nhttps://a.example/x", FORM), ("Text.\n\n— Ada Stone", FORM), ("Text.\n\nTHE END", CLOSED), ("Text.\n\n* * *", CLOSED),
        ("Text.\n\n(to be continued)", CLOSED), ("Text.\n\n## A heading", OPEN), ("終わりました。", CLOSED), ("これは途中", PLAIN), ("終わりました。これは途中", OPEN), ("lol that was so good", PLAIN), ("We bake.\n\n- Fresh bread from the corner bakery", PLAIN), ("- One ends as it should here.\n- The other one ends without any", OPEN), ("It rains. The others went", OPEN), ("", CLOSED), ("   ", CLOSED), ("Text.\n\nThanks,\nAda", FORM), ("Text.\n\nv6.23", FORM), ("broken �", OPEN),
    ],
)
def test_endings(text, kind):
    assert ending(text) == kind


def test_lengths():
    t = 'a<b>&"\n'
    n, b, u, hc, hb, jc, jb, ja, cc, cb = lengths(t)
    assert (n, b, u, hc, jc, cc) == (7, 7, 7, 7 + 3 + 3 + 4 + 5, 9, 8)
    assert lengths("é")[:3] == [1, 2, 1] and lengths("😀")[:3] == [1, 4, 2]


def test_labels():
    assert label_of("en_US") == label_of("EN") == label_of("English") == label_of("eng") == "en"
    assert label_of(None) is None and label_of("und") is None and label_of("x-default") is None and label_of(" ") is None
    assert label_of("zh-CN") == "zh-cn"


def test_blocks():
    long_ = "one two three four five six seven eight nine ten eleven twelve"
    b = blocks(f"# H\n\n{long_}\n{long_}\n\n- {long_}\n\n```\n{long_}\n```\n\n[x](/y) {long_}\n\nshort")
    assert [x.plain for x in b] == [False, True, False, False, False, False] and [x.number for x in b] == list(range(6))


def test_links_and_tags_of_any_length():
    from pagelake.llm.lines import anchors, find_links, replace_links

    EN = "The new bridges on the coast have been kept by a small group since the spring, and they meet once a week at the harbour and not only there."
    uri = "data:image/png;base64," + "iVBORw0KGgoAAAANSUhEUgAA" * 400
    article = f"# Bridges\n\n{EN}\n\nA view of the bridge from the harbour ![the bridge]({uri}) on the day of the opening, as it was then.\n\n{EN}"
    p = profile(article)
    assert quality_kind(p)[0] is None and p.other_chars < 500 and "base64" not in p.text
    assert leftovers(f'<img src="{uri}">') == ["html"] and leftovers("{{" + "x y " * 2000 + "}}") == ["wiki"]
    assert "base64" not in clean_markdown(article) and anchors(f"<a>{'x' * 5000}</a><a>open") == ["x" * 5000]
    bounded = re.compile(r"!?\[([^\]\n]*)\]\(([^)\s]*)\)")
    rnd = random.Random(1)
    for _ in range(20_000):
        s = "".join(rnd.choice("[]()!a\n ") for _ in range(rnd.randrange(24)))
        s = s.replace("] (", "](").replace("])", "](")
        assert [(m.start(), m.end(), *m.groups()) for m in bounded.finditer(s)] == find_links(s), s
        assert replace_links(s, find_links(s)) == bounded.sub(r"\1", s)
    assert find_links("[](" * 200_000) == []


def test_long_filler_is_residue():
    real = "The new bridges on the coast have been kept by a small group since the spring, and they meet once a week."
    model = fit([(0, [real, "At noon the harbour is closed to ships, as it was in the past."])] * 20)
    sample = "Describe the benefit of feature 12 in one or two sentences."
    short, long, content = (profile("# Page\n\n" + "\n\n".join([x] * n)) for x, n in ((sample, 8), (sample, 60), (real, 60)))
    assert long.prose > 40 and content.prose > 40
    assert model.kind(long) == model.kind(short) == "filler" and model.kind(content) is None


def test_residue_wording_is_learned_from_the_status():
    """No seed holds these words: short answers with an error status do, and EM
    carries them to a record whose status says nothing."""
    real = [(0, [PROSE, "At noon the harbour is closed to ships, as it was in the past."])] * 30
    notice = profile("# Zut alors, gremlins\n\nGremlins munched our cables")
    odd = [(trusted_kind(notice, 502), passages(notice))] * 4
    assert odd[0][0] == 3
    assert fit(real + odd).kind(notice) == "error_page"
    assert fit(real + [(0, passages(notice))] * 4).kind(notice) is None
    assert fit(real + odd).kind(profile("aGxq xq qrst zzq\n\nKqx qqw vx xk")) is None


@pytest.mark.parametrize(
    "html, text",
    [
        ("<pre><code><span>def</span> <span>f</span>(x):\n    return x\n\n# **a** [[b]]</code></pre>", "```\ndef f(x):\n    return x\n\n# **a** [[b]]\n```"),
        ("<ul><li>a<ul><li>b<li>c</ul><li>d <b>e</b> <code>x_{1}</code></ul><ol><li>one<li>two</ol>", "- a\n  - b\n  - c\n- d e `x_{1}`\n\n1. one\n2. two"),
        ("<p>H<sub>2</sub>O, x<sup>10</sup></p>", "H_2O, x^{10}"),
        ('<p><math><mi>x</mi><annotation encoding="application/x-tex">\\frac{1}{2}</annotation></math></p>', "$\\frac{1}{2}$"),
        ("<h2>T</h2><table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td>2</td></tr></table><p>Use <code>&lt;div&gt;</code></p>", "## T\n\na | b\n1 | 2\n\nUse `<div>`"),
        ("", ""),
    ],
)
def test_structure_is_kept(html, text):
    assert structured([parse(html)]) == text


@pytest.mark.parametrize(
    "markdown, text",
    [
        ("Use `<div>` and `[[a]]` but [[b|c]] <b>x</b>", "Use `<div>` and `[[a]]` but c x"),
        ("```\n<b>\n```\n\n`` a`b `` <i>y</i> `open <u>z</u>", "```\n<b>\n```\n\n`` a`b `` y `open z"),
    ],
)
def test_code_is_left_alone(markdown, text):
    assert clean_markdown(markdown) == text


def test_findings_come_from_the_content_subtrees():
    """Prose and lists of links: the threshold keeps every dense part, and what
    a link list shows is no finding."""
    menu = "<ul>" + "<li><a href='x'>**menu** entry</a></li>" * 12 + "</ul>"
    prose = "<div>" + f"<p>{PROSE} {PROSE}</p>" * 3 + "</div>"
    assert html_findings(f"<body>{menu}{prose}{menu}</body>")[0] == []
    marks, nodes = html_findings(f"<body>{menu}{prose}<div><p>{PROSE} **bold** {PROSE}</p><p>{PROSE}</p></div></body>")
    assert marks == ["markdown"] and all(n.tag != "ul" for n in nodes)


def test_block_rules_find_the_tail_without_cue_words():
    """No list knows these words: the body ends with its last strong paragraph,
    and what density and length tell apart behind it is boilerplate."""
    body = f"# Bridges\n\n{PROSE} {PROSE}\n\n- one pipe\n- two pipes\n\n{PROSE} {PROSE}"
    tail = "### Qorvat zil\n\n- [Bormu tal](https://a.example/1)\n- [Zelna kor](https://a.example/2)\n\nVebra dol nam\n\nThis is the place where all of the marks are held by those who made them."
    lines, _, flags = main_body(f"{body}\n\n{tail}")
    assert all(f is not False for f in flags[: body.count("\n") + 1])
    assert all(f is False for x, f in list(zip(lines, flags))[body.count("\n") + 1 :] if x)
    listy = "# Pipes\n\n" + f"{PROSE} {PROSE}\n\n" + "\n".join(f"pipe number {k} of iron" for k in range(9))
    assert all(f is not False for f in main_body(listy)[2])
    quoted = f"{body}\n\n> a short quotation\n\nred, green, blue, yellow, black"
    assert all(f is not False for f in main_body(quoted)[2])


def test_addresses_without_a_scheme_are_links():
    from pagelake.llm.spam import spam_kind, with_addresses

    rows = [f"host{k}.example/some/page-{k}" for k in range(12)]
    p = profile("# Addresses\n\n" + "\n\n".join(rows))
    known = [f"https://www.{x}/" for x in rows]
    assert spam_kind(p) != "links" and spam_kind(with_addresses(p, known)) == "links"
    assert with_addresses(p, None) is p and with_addresses(p, [None, "x"]) is p
