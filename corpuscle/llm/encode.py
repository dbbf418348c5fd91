"""Problem 8: encoding a whole corpus with a public byte-level BPE vocabulary.

Merges are found with a segment tree over the ranks of adjacent pairs: the root holds the leftmost pair of lowest
rank, each merge rewrites three leaves and their ancestors, so a piece of n bytes costs O(n log n) whatever its
length. Pieces are cut by the vocabulary's published pattern first; a piece that is itself a vocabulary entry needs no
merge, and short pieces are remembered per Python worker.

Defined results: null and empty texts give an empty list; lone surrogates cannot occur in Spark strings; special
tokens are never produced (their strings are ordinary text).
"""

from __future__ import annotations

import base64
import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Folder of the public vocabularies, unless a path is given.
TOKENIZERS = os.environ.get("CORPUSCLE_TOKENIZERS", "/opt/tokenizers")
#: The published pre-tokenisation pattern of the byte-level vocabularies (a fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The same for texts of ASCII characters only, where it needs no Unicode tables.
ASCII_PATTERN = (
    r"""'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"""
)
#: Pieces of at most this many characters are remembered, this many at a time.
REMEMBER_CHARS, REMEMBER = 24, 300_000
NONE = 1 << 62


def vocabulary_path(name: str = "byte_bpe_50k", folder: str | None = None) -> str:
    """The rank file of a vocabulary; ``folder`` defaults to :data:`TOKENIZERS`."""
    return os.path.join(folder or TOKENIZERS, f"{name}.tiktoken")


@lru_cache(maxsize=4)
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(None, map(bytes.strip, f)))}


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one piece by lowest-rank-first, leftmost merges on a segment tree."""
    n = len(piece)
    if n == 1:
        return [ranks[piece]]
    parts: list[bytes | None] = [piece[i : i + 1] for i in range(n)]
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    size = 1
    while size < n - 1:
        size *= 2
    tree = [NONE] * (2 * size)
    get = ranks.get
    for i in range(n - 1):
        r = get(piece[i : i + 2])
        if r is not None:
            tree[size + i] = r * n + i  # one number orders by rank, then by place
    for k in range(size - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b
    while (low := tree[1]) != NONE:
        i = low % n
        j = after[i]
        parts[i] = own = parts[i] + parts[j]
        parts[j] = None
        after[i] = nxt = after[j]
        changes = []
        if j < n - 1:
            changes.append((j, NONE))
        if nxt < n:
            before[nxt] = i
            r = get(own + parts[nxt])
            changes.append((i, NONE if r is None else r * n + i))
        else:
            changes.append((i, NONE))
        p = before[i]
        if p >= 0:
            r = get(parts[p] + own)
            changes.append((p, NONE if r is None else r * n + p))
        for leaf, value in changes:
            k = size + leaf
            if tree[k] == value:
                continue
            tree[k] = value
            while k > 1:
                a, b = tree[k], tree[k ^ 1]
                k >>= 1
                low = a if a < b else b
                if tree[k] == low:
                    break
                tree[k] = low
    return [ranks[x] for x in parts if x is not None]


class Pieces(dict):
    """Piece to ids; a piece not yet known is merged, and remembered if it is short."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks = ranks

    def __missing__(self, s: str) -> tuple[int, ...]:
        raw = s.encode("utf-8", "surrogatepass")
        whole = self.ranks.get(raw)
        ids = (whole,) if whole is not None else tuple(merge_piece(raw, self.ranks))
        if len(s) <= REMEMBER_CHARS:
            if len(self) >= REMEMBER:
                self.clear()
            self[s] = ids
        return ids


class Encoder:
    """Encodes texts with one vocabulary; one lives in each Python worker."""

    def __init__(self, path: str):
        import regex

        self.ranks = load_ranks(path)
        self.find, self.find_ascii = regex.compile(PATTERN).findall, re.compile(ASCII_PATTERN).findall
        self.known = Pieces(self.ranks)

    def ids(self, text: str) -> Iterator[int]:
        found = self.find_ascii(text) if text.isascii() else self.find(text)
        return chain.from_iterable(map(self.known.__getitem__, found))

    def encode(self, text: str | None) -> list[int]:
        return list(self.ids(text)) if text else []

    def count(self, text: str | None) -> int:
        return len(self.encode(text))


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encode_corpus(
    df: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), out_col: str = "ids",
    vocabulary: str | None = None, counts_only: bool = False,
) -> DataFrame:
    """``keep`` columns plus ``out_col``: the token ids of ``text_col``, or with ``counts_only`` their number.

    One row out for each row in; no shuffle. Null and empty texts give an empty list (count 0). Any other columns,
    whatever their names, are dropped before the Python workers see a row.
    """
    path = vocabulary or vocabulary_path()
    picked = df.select(*[F.col(c) for c in keep], F.col(text_col).alias("__text"))
    fields = [picked.schema[c] for c in keep]
    kind = T.LongType() if counts_only else T.ArrayType(T.IntegerType(), False)
    schema = T.StructType([*fields, T.StructField(out_col, kind, False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            texts = b.column(b.schema.get_field_index("__text"))
            kept = [b.column(i) for i in range(len(keep))]
            if counts_only:
                col = pa.array([enc.count(t.as_py()) for t in texts], pa.int64())
            else:
                ids, ends = array("i"), array("i", [0])
                for t in texts:
                    if t := t.as_py():
                        ids.extend(enc.ids(t))
                    ends.append(len(ids))
                col = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(memoryview(ids), pa.int32()))
            yield pa.RecordBatch.from_arrays([*kept, col], names=[*keep, out_col])

    return picked.mapInArrow(run, schema)
