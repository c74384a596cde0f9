"""Tokenizer, leakage search and repeated lines against brute force."""

from __future__ import annotations

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pagelake.llm.leakage import Patterns, leaked_items, words_of
from pagelake.llm.repeated import line_ids, normal_line, repeated_lines, without_repeated_lines
from pagelake.llm.tokenizer import Encoder, PairTree, decode, encode_texts, load_ranks, merge, vocabulary_path


@pytest.fixture(scope="module")
def ranks():
    return load_ranks(vocabulary_path("byte_bpe_50k.tiktoken"))


def naive_merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while True:
        pairs = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ranks]
        if not pairs:
            return [ranks[p] for p in parts]
        _, i = min(pairs)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


@settings(max_examples=300, deadline=None)
@given(st.text(min_size=1, max_size=60))
def test_merge_equals_naive(text):
    ranks = load_ranks(vocabulary_path("byte_bpe_50k.tiktoken")) if not hasattr(test_merge_equals_naive, "r") else test_merge_equals_naive.r
    test_merge_equals_naive.r = ranks
    piece = text.encode("utf-8", "surrogatepass")
    assert merge(piece, ranks) == naive_merge(piece, ranks)


def test_long_piece(ranks):
    piece = "".join(random.Random(1).choice("abcdetr") for _ in range(3000)).encode()
    assert merge(piece, ranks) == naive_merge(piece, ranks)


def test_pair_tree_gives_leftmost_least():
    t = PairTree([5, 3, 3, 9])
    assert t.least() == 1
    t.update(1, 1 << 60)
    assert t.least() == 2
    for i in range(4):
        t.update(i, 1 << 60)
    assert t.least() == -1


def test_encode_table(spark, ranks):
    texts = ["Hello world", None, "", "<|endoftext|> is text", "é漢字 😀\r\n\tx  y ", "x" * 20_000, "Hello world"]
    df = spark.createDataFrame([(i, t, t, "z") for i, t in enumerate(texts)], "doc_id LONG, text STRING, ids STRING, other STRING")
    got = {r.doc_id: r.ids for r in encode_texts(df, "doc_id", "text").collect()}
    assert got[1] == [] and got[2] == [] and got[0] == got[6]
    for i, t in enumerate(texts):
        assert decode(got[i], ranks) == (t or "")
    assert encode_texts(df.limit(0), "doc_id", "text").count() == 0
    tiktoken = pytest.importorskip("tiktoken")
    from pagelake.llm.tokenizer import PATTERN

    other = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert all(got[i] == other.encode_ordinary(t) for i, t in enumerate(texts) if t)
    assert Encoder(ranks).encode("a b") == other.encode_ordinary("a b")


def naive_leaks(text: str, items: list[tuple[int, str]], n: int) -> set[int]:
    w = words_of(text)
    have = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
    return {k for k, t in items for ws in [words_of(t)] if any(tuple(ws[i : i + n]) in have for i in range(len(ws) - n + 1))}


def test_wu_manber_equals_naive():
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(6)]
    for _ in range(300):
        items = [(k, " ".join(rng.choices(vocabulary, k=rng.randint(0, 9)))) for k in range(4)]
        text = " ".join(rng.choices(vocabulary + ["other"], k=rng.randint(0, 40)))
        assert Patterns(items, 4).search(text) == naive_leaks(text, items, 4)


def test_leaked_items(spark):
    item = " ".join(f"word{i}" for i in range(30))
    part = ", ".join(f"WORD{i}" for i in range(5, 18))
    docs = [(1, f"Before. {part}; after"), (2, " ".join(f"word{i}" for i in range(12))), (3, None), (4, ""), (5, item * 2), (6, f"x {part} y"), (7, "z" * 200_000)]
    df = spark.createDataFrame([(i, t, "a") for i, t in docs], "doc_id LONG, text STRING, item_id STRING")
    items = spark.createDataFrame([(10, item, "q"), (11, "too short", None), (12, None, None)], "item_id LONG, text STRING, answer STRING")
    got = {tuple(r) for r in leaked_items(df, "doc_id", "text", items, "item_id", "text").collect()}
    assert got == {(1, 10), (5, 10), (6, 10)}
    assert leaked_items(df, "doc_id", "text", items.limit(0), "item_id", "text").count() == 0
    assert leaked_items(df.limit(0), "doc_id", "text", items, "item_id", "text").count() == 0


def host(u):
    m = re.match(r"(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:@]+)", (u or "").strip().lower())
    return re.sub(r"^www\.", "", m.group(1)) if m else None


def brute_repeated(rows):
    docs, total, where = {}, {}, []
    for i, u, t in rows:
        h = host(u)
        if not h:
            continue
        total[h] = total.get(h, 0) + 1
        fence = False
        for n, line in enumerate((t or "").split("\n")):
            if line.strip()[:3] == "```":
                fence = not fence
            elif not fence and (k := normal_line(line)):
                docs.setdefault((h, k), set()).add(i)
                where.append((i, n, h, k))
    return {(i, n) for i, n, h, k in where if len(docs[h, k]) >= 4 and len(docs[h, k]) >= 0.1 * total[h]}


def test_repeated_lines_equal_brute_force_with_and_without_shards(spark):
    rng = random.Random(5)
    pool = ["Share  this page", "share this PAGE!", "Page 12 of 40", "Page 3 of 9", "All rights", "**", "12", "```", "unique"]
    rows = []
    for i in range(90):
        u = rng.choice(["https://www.a.example/x", "HTTP://A.EXAMPLE:80/y", "https://a.example", "https://b.example/z", None, "no address"])
        t = rng.choice([None, "", "\r\n".join(rng.choices(pool, k=8)), "\n".join([*rng.choices(pool, k=6), f"only {chr(97 + i % 26)}{i}"])])
        rows.append((i, u, t))
    df = spark.createDataFrame([(i, u, t, "c") for i, u, t in rows], "page_id LONG, url STRING, markdown STRING, source STRING")
    want = brute_repeated(rows)
    assert want
    for size in (4000, 7):
        got = [tuple(r) for r in repeated_lines(df, "page_id", "markdown", "url", shard_docs=size).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    kept = {r.page_id: r.text for r in without_repeated_lines(df, "page_id", "markdown", "url").collect()}
    for i, _, t in rows:
        expect = None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if (i, n) not in want)
        assert kept[i] == expect
    assert repeated_lines(df.limit(0), "page_id", "markdown", "url").count() == 0


def test_line_ids():
    assert line_ids("A b\n\n  a  B.\n12\n```\nA b\n```\na b 1\na b 22") == [line_ids("a b")[0], 0, line_ids("a b")[0], -1, -1, -1, -1, line_ids("a b 3")[0], line_ids("a b 3")[0]]


def test_suffix_array_equals_brute_force():
    import numpy as np

    from pagelake.llm.repeated import Shard, SuffixArray

    rnd = random.Random(2)
    for _ in range(200):
        ids = [rnd.randrange(4) for _ in range(rnd.randrange(1, 40))]
        got = SuffixArray(np.array(ids))
        assert got.order.tolist() == sorted(range(len(ids)), key=lambda i: ids[i:])
        for k in range(1, len(ids)):
            a, b = ids[got.order[k - 1] :], ids[got.order[k] :]
            assert got.lcp[k] == next((n for n, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    pages = [[5, 6, 7], [9, 5, 6, 7], [5, 6, 7, 1], [5, 6, 7, 2], []]
    s = Shard([1, 2, 3, 4, 5], pages)
    assert s.blocks(4)[0][1:] == (3, 4)  # three lines in four documents, found through their common prefix
    assert sorted(zip(*s.found(4), strict=True)) == [(1, 0), (1, 1), (1, 2), (2, 1), (2, 2), (2, 3), (3, 0), (3, 1), (3, 2), (4, 0), (4, 1), (4, 2)]
    assert s.found_ids(4).tolist() == [5, 6, 7] and Shard([1], [[]]).found(1) == ([], []) and Shard([], []).blocks(1) == []


def test_repeated_blocks_over_a_table(spark):
    from pagelake.llm.repeated import repeated_blocks

    block = "Legal notice of the house\nAll prices in crowns\nWritten on paper"
    rows = [(k, f"Page {'abcdefgh'[k]} alone\n\n{block}\n\nEnd {'abcdefgh'[k]}" if k < 6 else None, "https://a.example/") for k in range(8)]
    df = spark.createDataFrame(rows, "page_id LONG, markdown STRING, url STRING")
    got = repeated_blocks(df, "page_id", "markdown", "url").collect()
    assert max((r.lines, r.docs) for r in got) == (3, 6) and {r.source for r in got} == {"a.example"}
    assert repeated_blocks(df.limit(0), "page_id", "markdown", "url").count() == 0
