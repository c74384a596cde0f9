"""Every text operator over awkward tables, and whole small behaviours."""

from __future__ import annotations

import re

import pytest

from pagelake.llm.boilerplate import boilerplate_lines, main_text
from pagelake.llm.language import NAMES, detect_languages, fit_languages, label_of, language_found, read_languages, train, training_blocks, words_of
from pagelake.llm.markup import clean_documents
from pagelake.llm.quality import quality_found, quality_statistics
from pagelake.llm.residue import fit_residue, residue_records, without_residue
from pagelake.llm.spam import pair_counts, spam_records
from pagelake.llm.truncation import hidden_limits, text_endings, truncated, truncation_rates

DE = "Die neuen Brücken an der Küste werden seit dem Frühjahr von einer kleinen Gruppe betreut, die sich einmal in der Woche trifft und nicht nur am Hafen."
EN = "The new bridges on the coast have been kept by a small group since the spring, and they meet once a week at the harbour and not only there."
SCHEMA = "page_id LONG, url STRING, markdown STRING, html STRING, language STRING, word_count LONG, kind STRING, t STRING, i STRING"


def rows():
    page = f"Home > Help > X\n\n# Bridges\n\n{EN}\n\n{EN}\n\nShare this page with a friend"
    mixed = f"# Bridges\n\n{EN}\n\n{DE}\n\n{EN}"
    texts = [
        page, page, mixed, None, "", "   \n ", "# 404 Not Found\n\nPage not found", "x" * 100_000, "# Cheap\n\n" + "cheap bridge buy bridge best bridge " * 30,
        "# L\n\n" + "\n".join(f"1. [bridge](https://a.example/{i})" for i in range(20)), "# T\n\n" + "\n".join(f"- pipes ({i}), 4 cm" for i in range(14)), f"# N\n\n{DE}\n\n{DE}", "\x00\u2028😀",
    ]
    labels = ["en", None, "en", "de", "und", None, "en", "xx", "en", "en", "de", "en-GB", ""]
    counts = [len(page.split()), 1, None, 3, 0, 2, 6, 1, 5, 0, 9, None, 1]
    return [
        (k, "https://a.example/" if k % 3 else None, t, f"<body>\n<h1>x</h1>\n<p>{t}</p>\n</body>" if k % 2 else None, lab, n, "k", None, "i")
        for k, (t, lab, n) in enumerate(zip(texts, labels, counts, strict=True))
    ]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).cache()


def collect(df):
    got = [tuple(r) for r in df.collect()]
    assert len(got) == len(set(map(str, got)))
    return got


def test_boilerplate(docs):
    got = collect(boilerplate_lines(docs, "page_id", {"m": ("markdown", False), "h": ("html", True)}))
    assert ("m", 0, 0) in got and ("m", 1, 8) in got and not any(i in (3, 4, 5) and f == "m" for f, i, _ in got)
    body = dict(collect(main_text(docs, "page_id", "markdown")))
    assert body[0].startswith("# Bridges") and body[3] is None and body[4] is None and len(body) == len(rows())
    assert boilerplate_lines(docs.limit(0), "page_id", {"m": ("markdown", False)}).count() == 0


def test_residue(docs):
    got = dict(collect(residue_records(docs, "page_id", "markdown")))
    assert got[6] == "error_page" and not {0, 2, 3, 4, 8, 9, 10, 11} & set(got)
    assert without_residue(docs, "page_id", "markdown").count() == len(rows()) - len(got)
    empty = docs.limit(0)
    assert residue_records(empty, "page_id", "markdown").count() == 0


def test_spam(docs):
    got = dict(collect(spam_records(docs, "page_id", "markdown")))
    assert got.get(8) == "keywords" and got.get(9) == "links" and not {0, 2, 6, 10, 11} & set(got)
    pairs = pair_counts(docs, "markdown")
    assert pairs.n_words > 100 and pairs.mean_pmi("") is None
    assert spam_records(docs.limit(0), "page_id", "markdown").count() == 0


def test_quality(docs):
    got = [(i, k) for i, k, _ in collect(quality_found(docs, "page_id", "markdown", "word_count"))]
    kinds = {i: k for i, k in got if k != "word_count"}
    wrong = {i for i, k in got if k == "word_count"}
    assert kinds[10] == "list" and 0 not in wrong and 1 in wrong and not {2, 3, 4, 11} & wrong
    stats = {r.row_id: r for r in quality_statistics(docs, "page_id", "markdown").collect()}
    assert stats[3].words is None and stats[4].words == 0 and "words<50" in stats[6].reasons
    assert {r for *_, r in collect(quality_found(docs, "page_id", "markdown", "word_count"))} <= {"stated!=counted", "bullet_line_share>=0.6", "cell_line_share>=0.6", "word_share<0.55"}


def test_text_statistics_are_those_of_plain_python(spark):
    texts = ["a b\n- c.", "", None, " \n\t", "The cat # sat… on\u00a0the\u3000mat!\r\n* one\n2) two:\n\n\"End.\"", "{x} <y> | zz"]
    got = [r.asDict() for r in quality_statistics(spark.createDataFrame(list(enumerate(texts)), "i INT, t STRING"), "i", "t").sort("row_id").collect()]
    for t, r in zip(texts, got, strict=True):
        if t is None:
            assert all(r[k] is None for k in r if k != "row_id")
            continue
        words, lines = t.split(), [x for x in t.split("\n") if x.strip()]
        n, rows = len(words), len(lines)
        assert r["words"] == n
        assert r["mean_word_length"] == round(sum(map(len, words)) / n if n else 0, 6)
        assert r["symbol_ratio"] == round(len(re.findall(r"#|\.\.\.|…|[{}\\<>|~^]", t)) / n if n else 0, 6)
        assert r["bullet_lines"] == round(sum(bool(re.match(r"\s*(?:[-*+•]|\d{1,3}[.)])\s", x)) for x in lines) / rows if rows else 0, 6)
        assert r["punctuated_lines"] == round(sum(bool(re.search(r"[.!?…:;][\"')*_]*\s*$", x)) for x in lines) / rows if rows else 0, 6)
    assert "common_words<0.05" in got[5]["reasons"] and "common_words<0.05" not in got[4]["reasons"]


def test_language(docs):
    got = collect(language_found(docs, "page_id", "markdown", "language"))
    assert (11, -1, "de") in got and (1, -1, "en") in got and not any(i == 0 for i, _, _ in got)
    assert {(2, -1, "en"), (2, 1, "en"), (2, 2, "de"), (2, 3, "en")} <= set(got)
    assert not {3, 4, 5, 6, 8, 9, 10} & {i for i, _, _ in got}
    crf = fit_languages(docs, "page_id", "markdown", "language")
    all_ = collect(detect_languages(docs, "page_id", "markdown", crf))
    assert all(0 <= c <= 1 for *_, c, _ in all_)
    # a switch inside a block, which the learned transitions place
    words = words_of(f"{EN} {DE} {EN}")
    n, k = len(words_of(EN)), len(words_of(DE))
    parts = crf.segments(words)
    assert [x[2] for x in parts] == ["en", "de", "en"] and abs(parts[0][1] - n) <= 9 and abs(parts[1][1] - n - k) <= 9, parts
    assert crf.segments([]) == [] and crf.segments(words[:2])[0][2] == "en"
    # the messages run over whole blocks, and long ones are read in parts
    import pagelake.llm.language as module

    whole = crf.marginal_sums([words * 40])
    module.LONG, module.OVERLAP, kept = 300, 50, (module.LONG, module.OVERLAP)
    try:
        assert abs(crf.marginal_sums([words * 40]) - whole).max() < 0.5
    finally:
        module.LONG, module.OVERLAP = kept
    for foreign in ("今天早上我们和朋友一起去城里买面包和牛奶做晚饭", "오늘 아침 우리는 친구들과 함께 빵과 우유를 사러 시내에 갔습니다"):
        assert read_languages([foreign], crf)[0].whole == "other", foreign
    assert language_found(docs.limit(0), "page_id", "markdown", "language").count() == 0


def test_language_held_out():
    texts = {"en": EN, "de": DE}
    crf = train([(k, ws) for k, t in texts.items() for ws in training_blocks(f"{t}\n\n{t}", k)])
    read = read_languages([f"{DE}\n\n{EN}", "Les nouveaux ponts sont dans la ville et ils ne sont pas tous prêts pour cette année.", "", "123"], crf)
    assert [k for _, k, _, _ in read[0].parts] == ["de", "en"] and read[1].whole == "fr" and read[2] is None and read[3] is None
    assert set(NAMES) == {label_of(k) for k in NAMES}


def test_markup(docs, spark):
    got = clean_documents(docs, "page_id", "markdown", "html").collect()
    assert all(r.markup == [] for r in got if r.field == "markdown" and r.page_id in (0, 2, 11))
    extra = spark.createDataFrame(
        [(1, "a [[b|c]] d " + EN, None, "x"), (2, None, "<body><p>" + EN + " &lt;b&gt;x&lt;/b&gt;</p></body>", "y"), (3, "", "", None)], "page_id LONG, markdown STRING, html STRING, text STRING"
    )
    marks = {(r.page_id, r.field): r.markup for r in clean_documents(extra, "page_id", "markdown", "html").collect()}
    assert marks == {(1, "markdown"): ["wiki"], (2, "html"): ["html"]}
    assert clean_documents(extra.limit(0), "page_id", "markdown", "html").count() == 0


def test_truncation(spark):
    sentence = "The canal opens at nine and closes once the market is full. "
    rows_ = []
    for k in range(60):  # source a cuts at 200 characters, b doesn't cut
        text = sentence * (2 + k % 5) + f"A note of the day {k}."
        rows_.append((k, text[:200] if k % 2 else text[: 130 + k] + ".", "a", None, "z"))
        rows_.append((100 + k, sentence * 3 + f"Number {k} is here.", "b", 5 if k % 3 else None, None))
    rows_ += [(900, None, "a", 1, None), (901, "", "b", None, None), (902, "  ", None, None, None), (903, "Text. Unfinished sen", None, 5000, None), (904, "Text.\n\n- stone br", "b", 500, None), (905, "Text.\n\n- market", "b", None, None)]
    df = spark.createDataFrame(rows_, "doc_id LONG, text STRING, source STRING, content_length LONG, cut STRING")
    got = {r.doc_id: r for r in truncated(df, "doc_id", "text", "source", "content_length").collect()}
    assert not {900, 901, 902} & set(got) and got[903].cut and got[904].cut and not got[905].cut
    assert not any(got[100 + k].cut for k in range(60))
    assert sum(got[k].cut for k in range(1, 60, 2)) >= 20
    limits = {(r.source, r.len) for r in hidden_limits(text_endings(df, "doc_id", "text", "source", "content_length")).where("measure = 0").collect()}
    assert ("a", 200) in limits
    assert all(got[k].reason == "limit" for k in range(1, 60, 2) if got[k].cut) and got[904].reason == "declared" and got[905].reason is None
    # a plain ending is cut at a limit of its source only
    titles = [(k, ("Title " + "abcdefghij"[k % 10] + " of things and more things " * 4)[:80].rstrip() if k < 40 else "Title " + "of things " * (k % 9 + 2), "t" if k < 40 else "u", None, None) for k in range(80)]
    names = {r.doc_id: r for r in truncated(spark.createDataFrame(titles, df.schema), "doc_id", "text", "source").collect()}
    assert not any(names[k].cut for k in range(40, 80))
    rates = {r.source: r.rate for r in truncation_rates(truncated(df, "doc_id", "text", "source")).collect()}
    assert rates["a"] > 0.3 and rates["b"] < 0.1
    assert truncated(df.limit(0), "doc_id", "text", "source").count() == 0


def test_fit_on_an_empty_table(docs):
    m = fit_residue(docs.limit(0), "page_id", "markdown")
    assert m.weights


def test_spam_verdict_does_not_depend_on_the_size_of_the_table(spark):
    import random

    def corpus(times):
        rnd = random.Random(5)
        made = []
        for k in range(3000):
            x = "abcdefghijklmnop"
            words = [x[(k * 7 + j) % 16] + x[rnd.randrange(16)] + x[rnd.randrange(16)] for j in range(60)]
            made.append((k, " ".join(words)))
        copies = spark.createDataFrame(made, "page_id LONG, markdown STRING").crossJoin(spark.range(times).withColumnRenamed("id", "copy"))
        return copies.select("page_id", "markdown")

    # common words that never meet, and pairs that always do: only the first is salad
    some = [w for r in corpus(1).limit(40).collect() for w in r.markdown.split()[::2]]
    salad = " ".join(some[i] for i in range(0, 60, 2))
    scores = [[pair_counts(corpus(n), "markdown").mean_pmi(t, own=False) for t in (salad, corpus(1).first().markdown)] for n in (1, 40)]
    assert scores[0] == pytest.approx(scores[1], abs=0.01)
    assert pair_counts(corpus(40), "markdown").n_words == 40 * 3000 * 60


def test_last_words_are_looked_up_exactly(spark):
    # more words than a table of 2^20 buckets can tell apart: each bucket is full many times
    rare = "Text.\n\n- stone brxq"
    texts = [(k, " ".join(f"{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}" + "".join(chr(97 + (j // 26**d) % 26) for d in range(4)) for j in range(20_000)) + ".", "a", None) for k in range(240)]
    texts += [(1000, rare, "a", None), (1001, "Text.\n\n- stone", "a", None), (1002, "A stone wall.", "a", None)]
    df = spark.createDataFrame(texts, "doc_id LONG, text STRING, source STRING, content_length LONG")
    got = {r.doc_id: r.cut for r in truncated(df, "doc_id", "text", "source", "content_length").collect()}
    assert got[1000] and not got[1001] and not got[1002]
