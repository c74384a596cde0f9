"""Problem 8: encoding of the whole corpus with a public tokenizer.

Byte-level BPE from a rank file.  A text is split into pieces by the
vocabulary's pattern; each piece's merges run on a segment tree over the ranks
of adjacent pairs: the root is the leftmost pair of lowest rank, a merge updates
the pairs on either side in logarithmic time, until no pair is mergeable.
Encoded pieces are remembered per worker, so a piece is merged once.

Null and empty texts give an empty list.  Text that looks like a special token
is ordinary text.  Long texts and long pieces need no other path.  No shuffle.
"""

from __future__ import annotations

import base64
import os
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .engine import pick, spread

PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
FOLDER = "/opt/tokenizers"
CACHE_PIECES = 400_000
NONE = 1 << 60


def vocabulary_path(name: str, folder: str | None = None) -> str:
    """Place of a rank file: in ``folder``, else where the installed package of
    public tokenizers says, else in the default folder."""
    if folder:
        return os.path.join(folder, name)
    try:
        import public_tokenizers
    except ImportError:
        return os.path.join(FOLDER, name)
    return public_tokenizers.path(name)


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class PairTree:
    """Segment tree of the least (rank, position) over adjacent pairs."""

    def __init__(self, ranks: list[int]):
        size = 1
        while size < max(1, len(ranks)):
            size *= 2
        self.size = size
        self.tree = [NONE] * (2 * size)
        for i, r in enumerate(ranks):
            self.tree[size + i] = r << 32 | i if r < NONE else NONE << 4
        for i in range(len(ranks), size):
            self.tree[size + i] = NONE << 4
        for i in range(size - 1, 0, -1):
            a, b = self.tree[2 * i], self.tree[2 * i + 1]
            self.tree[i] = a if a <= b else b

    def update(self, i: int, rank: int) -> None:
        t = self.tree
        k = self.size + i
        t[k] = rank << 32 | i if rank < NONE else NONE << 4
        k >>= 1
        while k:
            a, b = t[2 * k], t[2 * k + 1]
            low = a if a <= b else b
            if t[k] == low:
                break
            t[k] = low
            k >>= 1

    def least(self) -> int:
        """Position of the leftmost pair of lowest rank, -1 for none."""
        x = self.tree[1]
        return -1 if x >= NONE << 4 else x & 0xFFFFFFFF


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one piece."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    parts: list[bytes | None] = [piece[i : i + 1] for i in range(n)]
    if n == 1:
        return [ranks[piece]]
    after = list(range(1, n + 1))
    ahead = list(range(-1, n - 1))
    get = ranks.get
    tree = PairTree([get(piece[i : i + 2], NONE) for i in range(n - 1)])
    while (i := tree.least()) >= 0:
        j = after[i]
        parts[i] += parts[j]
        parts[j] = None
        k = after[i] = after[j]
        if j < n - 1:
            tree.update(j, NONE)
        if k < n:
            ahead[k] = i
            tree.update(i, get(parts[i] + parts[k], NONE))
        else:
            tree.update(i, NONE)
        h = ahead[i]
        if h >= 0:
            tree.update(h, get(parts[h] + parts[i], NONE))
    return [ranks[p] for p in parts if p is not None]


class Encoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        import regex

        self.ranks = ranks
        self.split = regex.compile(pattern).findall
        self.known: dict[str, tuple[int, ...]] = {}

    def extend(self, text: str, out: array) -> None:
        """Appends the ids of a text to ``out``."""
        known = self.known
        if len(known) > CACHE_PIECES:
            known.clear()
        add = out.extend
        for piece in self.split(text):
            ids = known.get(piece)
            if ids is None:
                ids = known[piece] = tuple(merge(piece.encode("utf-8", "surrogatepass"), self.ranks))
            add(ids)

    def encode(self, text: str) -> list[int]:
        out = array("i")
        self.extend(text, out)
        return out.tolist()


_encoders: dict[tuple[str, str], Encoder] = {}


def encode_texts(df: DataFrame, id_col: str, text_col: str, vocabulary: str = "byte_bpe_50k.tiktoken", folder: str | None = None) -> DataFrame:
    """(doc_id, ids): token ids of every text, without special tokens."""
    path = vocabulary_path(vocabulary, folder)
    held = df.sparkSession.sparkContext.broadcast(load_ranks(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (path, PATTERN)
        encoder = _encoders.get(key)
        if encoder is None:
            encoder = _encoders[key] = Encoder(held.value)
        target = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])
        for b in batches:
            for start in range(0, b.num_rows, 500):
                part = b.slice(start, 500)
                flat, ends = array("i"), array("i", [0])
                for t in part.column(1).to_pylist():
                    if t:
                        encoder.extend(t, flat)
                    ends.append(len(flat))
                values = pa.array(memoryview(flat).cast("B").cast("i") if len(flat) else [], type=pa.int32())
                ids = pa.ListArray.from_arrays(pa.array(ends, type=pa.int32()), values)
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), ids.cast(target.field(1).type)], schema=target)

    return spread(pick(df, doc_id=id_col, t=text_col)).mapInArrow(run, "doc_id BIGINT, ids ARRAY<INT>")


def decode(ids: list[int], ranks: dict[bytes, int]) -> str:
    by_id = {v: k for k, v in ranks.items()}
    return b"".join(by_id[i] for i in ids).decode("utf-8", "surrogatepass")
