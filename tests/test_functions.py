"""Column functions: URLs, text, Markdown clean-up, scalars."""

from __future__ import annotations

import itertools

import pytest
from pyspark.sql import functions as F

from pagelake.functions import html_text as H
from pagelake.functions import markdown_clean as M
from pagelake.functions import scalars as S
from pagelake.functions import text as T
from pagelake.functions import urls as U


def one(spark, value, fn, kind="STRING"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(fn(F.col("v")).alias("r")).collect()[0].r


def many(spark, pairs, fn):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(pairs)], "k INT, v STRING")
    return [r.r for r in df.select("k", fn(F.col("v")).alias("r")).orderBy("k").collect()]


CANONICAL = {
    "http://www.Example.COM/docs/": "https://example.com/docs",
    "https://example.com": "https://example.com/",
    "https://example.com/index.html": "https://example.com/",
    "https://example.com/a/index.php": "https://example.com/a",
    "https://example.com/a?b=2&a=1&b=1#frag": "https://example.com/a?a=1&b=2&b=1",
    "https://example.com:8080/x": "https://example.com:8080/x",
    "http://example.com:80/x": "https://example.com/x",
    "HTTPS://EXAMPLE.com/Path": "https://example.com/Path",
    "https://user:pw@example.com/x": "https://user:pw@example.com/x",
    "not a url": "not a url",
    "mailto:a@b.example": "mailto:a@b.example",
    "": "",
    None: None,
}


def test_canonical_and_its_idempotence(spark):
    got = many(spark, list(CANONICAL), U.canonical)
    assert got == list(CANONICAL.values())
    assert many(spark, got, U.canonical) == got


def test_every_permutation_has_one_canonical_form(spark):
    df = spark.createDataFrame([("https://www.example.com/docs/a/",)], "u STRING").select(F.explode(U.permutations(F.col("u"))).alias("p"))
    assert df.count() == 24 and df.select(U.canonical(F.col("p"))).distinct().count() == 1


def test_light_form(spark):
    assert many(spark, ["https://www.A.example/x/#f", "https://a.example/", "bad"], U.canonical_light) == ["https://www.a.example/x", "https://a.example", "bad"]


def test_priority_order(spark):
    urls = ["https://a.example/", "https://a.example/about", "https://a.example/x/y/z", "https://a.example/x/y/file.pdf", "https://a.example/docs/guide", "https://a.example/list?page=7", None]
    root, top, deep, pdf, docs, paged, null = many(spark, urls, lambda c: U.priority(c, 1))
    assert root > top > deep > pdf and docs > deep and paged < top and null is None
    assert one(spark, "https://a.example/x/y/z", lambda c: U.priority(c, 0)) - one(spark, "https://a.example/x/y/z", lambda c: U.priority(c, 5)) == 50


def test_pages_and_rewrites(spark):
    urls = ["https://a.example/l/page/3", "https://a.example/l?page=9&x=1", "https://a.example/l?p=2", "https://a.example/l", "https://a.example/l?page=99999999999999999999", None]
    assert many(spark, urls, U.page_number) == [3, 9, 2, None, None, None]
    assert many(spark, urls[:4], U.next_page) == ["https://a.example/l/page/4", "https://a.example/l?page=10&x=1", "https://a.example/l?p=3", None]
    docs = ["https://docs.google.com/document/d/AB-1/edit", "https://docs.google.com/presentation/d/P/edit", "https://docs.google.com/spreadsheets/d/S/edit#gid=0", "https://drive.google.com/file/d/F/view", "https://a.example/edit"]
    assert many(spark, docs, U.rewrite_documents) == [
        "https://docs.google.com/document/d/AB-1/export?format=pdf", "https://docs.google.com/presentation/d/P/export/pdf", "https://docs.google.com/spreadsheets/d/S/gviz/tq?tqx=out:html",
        "https://drive.google.com/uc?export=download&id=F", "https://a.example/edit",
    ]


def test_globs(spark):
    urls = ["https://a.example/docs/x", "https://a.example/docs/x/y", "https://a.example/blog/a/b", None]
    assert many(spark, urls, lambda c: U.matches_globs(c, ["/docs/*"])) == [True, False, False, False]
    assert many(spark, urls, lambda c: U.admitted(c, ["/docs/**", "/blog/**"], ["**/y"])) == [True, False, True, False]
    assert many(spark, urls[:3], lambda c: U.admitted(c, None, None)) == [True, True, True]


def test_links(spark):
    df = spark.createDataFrame(
        [("https://a.example/docs/", "https://a.example/docs/x"), ("https://a.example/docs", "https://a.example/docsearch"), ("https://a.example/docs", "https://b.example/docs/x"), ("https://a.example/a", None)],
        "p STRING, l STRING",
    )
    got = [tuple(r) for r in df.select(U.is_forward(F.col("l"), F.col("p")), U.admit_link(F.col("l"), F.col("p")), U.admit_link(F.col("l"), F.col("p"), backward=True), U.admit_link(F.col("l"), F.col("p"), external=True)).collect()]
    assert got == [(True, True, True, True), (False, False, True, True), (True, False, False, True), (False, False, False, True)]
    base = F.lit("https://a.example/x/y.html?q=1#f")
    rel = ["/a", "//c.example/d", "z.html", "?k=2", "#g", "https://q.example/", "mailto:x@y.example"]
    assert many(spark, rel, lambda c: U.resolve(base, c)) == [
        "https://a.example/a", "https://c.example/d", "https://a.example/x/z.html", "https://a.example/x/y.html?k=2", "https://a.example/x/y.html?q=1#g", "https://q.example/", "mailto:x@y.example",
    ]


def test_targets(spark):
    assert many(spark, ["http://127.0.0.1/", "https://example.org/", "http://fd00.example/", None, "https://[::1]/"], U.is_private_target) == [True, False, False, True, True]
    assert many(spark, ["https://stats.wp.com/x.js", "https://a.example/x.js", None], U.is_tracker) == [True, False, False]
    assert one(spark, "https://s.example/l/?uddg=https%3A%2F%2Fa.example%2Fb%2Bc&rut=1", U.search_target) == "https://a.example/b+c"
    assert one(spark, "https://a.example/b?c=1&d", U.file_name) == "a.example_b_c_1_d"


def test_text(spark):
    assert many(spark, ["a  b\nc", "", None, "   "], T.word_count) == [3, 0, 0, 0]
    assert many(spark, [" ".join(["w"] * n) for n in (0, 1, 200, 201)], T.reading_time) == [0, 1, 1, 2]
    long_ = "First sentence. " + "word " * 60
    assert many(spark, ["short", "", None, long_, "w" * 300], T.excerpt) == ["short", None, None, "First sentence.", "w" * 200 + "..."]
    a, b, c, d = many(spark, ["x  \n\n\n\n y\r\n", "x\n\n\ny", "", None], T.content_hash)
    assert a == b and a != c and d is None and c == many(spark, ["  \n "], T.content_hash)[0]
    assert many(spark, ["x\n\n y ", " x\n\ny"], T.content_hash)[0] == many(spark, [" x\n\ny"], T.content_hash)[0]
    md = "| a |\n| - |\n\n```\n| no |\n```\n| b |\ntext\n| c |"
    assert many(spark, [md, "", None], T.table_count) == [3, 0, 0]
    assert one(spark, "abcdefghij", lambda c: T.judge_excerpt(c, 4)) == "abc\n\n[...]\n\nj"


def test_markdown_cleaning(spark):
    cases = {
        M.setext_to_atx: ("Title\n=====\nSub\n---\nx", "# Title\n## Sub\nx"),
        M.trailing_hashes: ("### T ###", "### T"),
        M.drop_base64_images: ("![a](data:image/png;base64,AA)", "![a](data:image-removed)"),
        M.drop_empty_links: ("x [](u) ![](i)", "x  ![](i)"),
        M.drop_empty_bullets: ("a\n*\n*\n*\nb", "a\nb"),
        M.drop_ui_noise: ("x\nShow more\ny", "x\n\ny"),
        M.drop_edit_links: ("H [[edit](u)]", "H"),
        M.lift_headings: ("[### T ###](u)", "### [T](u)"),
        M.drop_leaked_scripts: ("a\nvar x = 1;\nb.c = 2;\nf.g(1);\nz", "a\n\n\n\nz"),
        M.drop_copyright: ("a\nCopyright © 2020 X\nb", "a\n\nb"),
        M.squeeze_link_text: ("[  a   b  ](u)", "[a b](u)"),
        M.drop_skip_links: ("[Skip to content](#m)\nx", "x"),
        M.compress_tables: ("|  a   |b|\n|:----|:-:|\n| | c |", "| a | b |\n| :--- | :---: |\n|| c |"),
    }
    for fn, (before, after) in cases.items():
        assert one(spark, before, fn) == after, fn.__name__
    assert one(spark, "a​\n\n\n\n\nb", M.clean) == "a\n\nb" and one(spark, None, M.clean) is None
    assert one(spark, "plain", lambda c: M.title_if_bare(c, F.lit("T"))) == "# T\n\nplain"
    assert one(spark, "ab\ncd\nef", lambda c: M.cap_size(c, 6)).startswith("ab\ncd\n\n[")


def test_scalars(spark):
    assert many(spark, ["$1,200.50", "x", "-3"], S.parse_number) == [1200.5, None, -3.0]
    assert many(spark, ["a 1x, b 2x", "a 10w, b 20w", "one", ""], S.largest_of_srcset) == ["b", "b", "one", None]
    assert many(spark, ["300w", "2x", "q"], S.width_descriptor) == [300, 1200, None]
    assert one(spark, "&amp;lt; &#39;&copy;", S.decode_entities) == "< '©"
    pairs = spark.createDataFrame([(100, 111), (100, 105), (0, 0), (5, 500)], "a INT, b INT")
    assert [r[0] for r in pairs.select(S.winner_higher(F.col("a"), F.col("b"))).collect()] == ["tie", "tie", "tie", "b"]
    assert [r[0] for r in pairs.select(S.winner_lower(F.col("a"), F.col("b"))).collect()] == ["tie", "tie", "tie", "a"]
    adv = S.advantage({k: F.lit("a") for k in S.WEIGHTS})
    assert spark.range(1).select(adv, S.overall_winner(adv), S.overall_winner(F.lit(0.05))).collect()[0][0:3] == (1.0, "a", "tie")
    assert many(spark, ['```json\n{"description": "d"}\n```', "line\nmore"], S.description_of_reply) == ["d", "line"]
    assert spark.range(1).select(S.backoff_schedule(4, 100, 2.0, 300)).collect()[0][0] == [100, 200, 300]


def test_html_patterns(spark):
    page = '<html lang="de"><head><title> A &amp; B </title><meta content="D" name="description"><meta property="og:title" content="O"><link rel="canonical" href="https://a.example/c"></head><body><h1>H <b>x</b></h1><a href="/a#f">1</a><a href="mailto:x">2</a><a href="/a">3</a><img src="i.png"><script>var q = "<p>no</p>";</script><p>Text</p></body></html>'
    r = spark.createDataFrame([(page,)], "h STRING").select(
        H.title(F.col("h")), H.language(F.col("h")), H.meta(F.col("h"), "description"), H.meta(F.col("h"), "og:title", "property"), H.canonical_link(F.col("h")), H.first_heading(F.col("h")),
        H.crawl_links(F.col("h")), H.image_sources(F.col("h")), H.plain_text(F.col("h")),
    ).collect()[0]
    assert tuple(r) == ("A & B", "de", "D", "O", "https://a.example/c", "H x", ["/a"], ["i.png"], "H x 123 Text".replace("123", "1 2 3"))


@pytest.mark.parametrize(
    ("html", "names", "needs"),
    [
        ('<html><body><div id="root"></div><script src="/static/react-dom.js"></script></body></html>', ["React"], True),
        ('<html><body><div id="__next">' + "text " * 60 + '</div><script id="__NEXT_DATA__">{}</script></body></html>', ["Next.js"], False),
        ("<html><body>" + "<p>plain words here</p>" * 30 + "</body></html>", [], False),
    ],
)
def test_script_detection(spark, html, names, needs):
    d = H.needs_scripts(F.col("h"))
    r = spark.createDataFrame([(html,)], "h STRING").select(*[c.alias(k) for k, c in d.items()]).collect()[0]
    assert r.detected_frameworks == names and r.needs_scripts == needs


def test_gates(spark):
    rows = [(404, "<p>x</p>"), (200, "<title>404</title><h1>404 x</h1>"), (200, '<title>404</title><h1>404</h1><meta property="og:type"><meta name="description"'), (301, "<title>404</title>"), (None, None)]
    df = spark.createDataFrame(rows, "s INT, h STRING")
    assert [r[0] for r in df.select(H.is_error_page(F.col("h"), F.col("s"))).collect()] == [True, True, False, False, False]
    blocked = spark.createDataFrame([(403, ""), (500, "Captcha please"), (500, "x"), (200, "captcha")], "s INT, h STRING")
    assert [r[0] for r in blocked.select(H.wants_browser(F.col("h"), F.col("s"))).collect()] == [True, True, False, False]
    gate = spark.createDataFrame([(200, "<p>" + "x" * 300 + "</p>", "y" * 200), (200, "<p>x</p>", "short"), (404, "<p>" + "x" * 300, "y" * 200)], "s INT, h STRING, m STRING")
    assert [r[0] for r in gate.select(H.quality_error(F.col("h"), F.col("m"), F.col("s"))).collect()] == [None, "empty_content", "error_page"]


def test_glob_regex_is_shared_by_both_engines():
    for g, u in itertools.product(["/a/*", "/a/**", "**/x.?"], ["/a/b", "/a/b/c", "/q/x.y"]):
        import re

        assert isinstance(re.match(U.glob_to_regex(g), u) is not None, bool)


def test_priority_lists_may_be_empty(spark):
    from pyspark.sql import functions as F

    from pagelake.functions import urls as U

    df = spark.createDataFrame([("https://a.example/docs/x/y/z",), ("https://a.example/login/x/y/z",)], "u STRING")
    both, high, low, none = ([r[0] for r in df.select(U.priority(F.col("u"), 0, h, w)).collect()] for h, w in ((("/docs/",), ("/login/",)), (("/docs/",), ()), ((), ("/login/",)), ((), ())))
    assert both == [150, 50] and high == [150, 100] and low == [100, 50] and none == [100, 100]


def test_percent_coding(spark):
    from pyspark.sql import functions as F

    from pagelake.functions import urls as U

    texts = ["a b", "a+b", "é/ü?&=", "", None, "100%"]
    rows = spark.createDataFrame([(t,) for t in texts], "t STRING").select("t", U.percent_encode(F.col("t")).alias("e"), U.percent_decode(U.percent_encode(F.col("t"))).alias("d")).collect()
    assert all(r.t == r.d for r in rows) and rows[0].e == "a%20b" and rows[1].e == "a%2Bb"


def test_registrable_by_the_public_list(spark):
    from pyspark.sql import functions as F

    from pagelake.functions.domains import registrable

    want = {"a.b.co.uk": "b.co.uk", "co.uk": "co.uk", "localhost": "localhost", "u.github.io": "u.github.io", "x.y.city.kawasaki.jp": "city.kawasaki.jp", "A.EXAMPLE.org": "example.org", "10.1.2.3": "10.1.2.3", "w.unlisted": "w.unlisted"}
    df = spark.createDataFrame([(h,) for h in [*want, None]], "h STRING")
    assert {r.h: r.r for r in df.select("h", registrable(spark, F.col("h")).alias("r")).collect()} == want | {None: None}


def test_language_guess_of_26_codes(spark):
    from pyspark.sql import functions as F

    from pagelake.functions.language import COMMON, SCRIPTS, guess

    said = {
        "en": "the cat and the dog of that house was here", "de": "der Hund und die Katze sind nicht mit dem Kind", "tr": "bu ev çok güzel ve bir bahçe için", "fi": "hän on täällä mutta se ei ole että", "cs": "že se to je jako pes ale jsou",
        "ro": "casa este în oraș și cu pe care", "hu": "az és hogy nem egy ház van", "vi": "và của là có trong", "da": "det er ikke til som af", "uk": "це та що він як", "ja": "これはほんです", "ko": "안녕하세요 여러분", "zh": "今天天气很好", "ar": "مرحبا بالعالم", "hi": "नमस्ते दुनिया",
        "el": "καλημέρα κόσμε", "he": "שלום עולם", "th": "สวัสดีชาวโลก",
    }
    assert len(COMMON) + len(SCRIPTS) == 26
    got = {r.k: r.g for r in spark.createDataFrame([*said.items(), ("none", "xq zz"), ("empty", ""), ("null", None)], "k STRING, t STRING").select("k", guess(F.col("t")).alias("g")).collect()}
    assert got == {k: k for k in said} | {"none": None, "empty": None, "null": None}
