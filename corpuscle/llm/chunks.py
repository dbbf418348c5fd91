"""Problem 7: cutting oversized texts at natural boundaries.

Agglomerative merging: a text starts as atomic segments (sentences; words of a sentence that is itself too long; runs
of characters of a word that is too long). Every boundary between neighbours has a strength: inside a word 0, word 1,
sentence 2, line 3, paragraph 4. A heap holds the neighbouring pairs; the weakest boundary is merged first (then the
smaller result, then the earlier place) as long as the result with its overlap fits the limit. What is left are the
strongest boundaries that the limit allows.

Sizes are in Unicode code points. Every piece but the first begins with the last ``overlap`` characters of the piece
before, its body follows on without a gap, and white space stays with the piece it ends.

Defined results: null texts and texts within the limit give no row; a text without any boundary is cut at the limit;
repeated rows are each cut; columns of other names are ignored.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

HARD, WORD, SENTENCE, LINE, PARAGRAPH = range(5)
#: Ends of atomic segments: paragraph, line, sentence (Latin: mark, closers, blank; CJK: mark alone).
_ENDS = re.compile(r"(?P<p>\r?\n[^\S\n]*\r?\n\s*)|(?P<l>\r?\n|\r)|(?P<s>[.!?…]+[\"'”’)\]]*\s+|[。！？]+[”’」』）]*\s*)")
_WORD_ENDS = re.compile(r"\s+")
_STRENGTH = {"p": PARAGRAPH, "l": LINE, "s": SENTENCE}


def atoms(text: str, most: int) -> list[tuple[int, int]]:
    """(end, strength of the boundary at that end) of the atomic segments, each of at most ``most`` characters."""
    ends: list[tuple[int, int]] = []
    start = 0

    def segment(begin: int, end: int, strength: int) -> None:
        if end - begin <= most:
            ends.append((end, strength))
            return
        at = begin
        for m in [*_WORD_ENDS.finditer(text, begin, end), None]:
            to = m.end() if m else end
            if to == at:
                continue
            while to - at > most:
                at += most
                ends.append((at, HARD))
            if to > at:
                ends.append((to, WORD))
                at = to
        ends[-1] = (end, strength)

    for m in _ENDS.finditer(text):
        if m.end() > start:
            segment(start, m.end(), _STRENGTH[m.lastgroup])
            start = m.end()
    if start < len(text):
        segment(start, len(text), PARAGRAPH)
    return ends


def cut_text(text: str, limit: int = 4000, overlap: int = 200) -> list[tuple[int, int]]:
    """(begin, end) of the bodies; a piece is ``text[max(0, begin - overlap):end]``."""
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be smaller than the limit")
    if len(text) <= limit:
        return [(0, len(text))]
    ends = atoms(text, limit - overlap)
    n = len(ends)
    begin = [0, *[e for e, _ in ends[:-1]]]
    end = [e for e, _ in ends]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    version = [0] * n  # of the segment that starts at atom i; -1: merged away

    def pair(i: int) -> tuple[int, int, int, int, int, int] | None:
        j = after[i]
        if j >= n:
            return None
        size = end[j] - begin[i]
        if size + min(overlap, begin[i]) > limit:
            return None
        return ends[j - 1][1], size, i, j, version[i], version[j]

    heap = [p for i in range(n) if (p := pair(i))]
    heapq.heapify(heap)
    while heap:
        _, _, i, j, vi, vj = heapq.heappop(heap)
        if version[i] != vi or version[j] != vj:
            continue
        end[i] = end[j]
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
        version[j] = -1
        version[i] += 1
        for k in (i, before[i]):
            if k >= 0 and (p := pair(k)):
                heapq.heappush(heap, p)
    out, i = [], 0
    while i < n:
        out.append((begin[i], end[i]))
        i = after[i]
    return out


def split_texts(
    df: DataFrame, text_col: str = "main_text", key: str = "doc_id", limit: int = 4000, overlap: int = 200
) -> DataFrame:
    """(key, piece_no, begin, end, piece) of every text of more than ``limit`` characters; no shuffle.

    ``begin``/``end`` are the character range of the body, ``piece`` is the body behind its overlap.
    """
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be smaller than the limit")
    long = df.where(F.char_length(F.col(text_col)) > limit).select(F.col(key), F.col(text_col).alias("__text"))
    fields = [
        long.schema[key], T.StructField("piece_no", T.LongType(), False), T.StructField("begin", T.LongType(), False),
        T.StructField("end", T.LongType(), False), T.StructField("piece", T.StringType(), False),
    ]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            place, no, begins, ends, pieces = [], [], [], [], []
            for r, text in enumerate(b.column(1)):
                text = text.as_py()
                for k, (s, e) in enumerate(cut_text(text, limit, overlap), 1):
                    place.append(r)
                    no.append(k)
                    begins.append(s)
                    ends.append(e)
                    pieces.append(text[max(0, s - overlap) : e])
            cols = [pa.array(no, pa.int64()), pa.array(begins, pa.int64()), pa.array(ends, pa.int64()), pa.array(pieces, pa.string())]
            keys = b.column(0).take(pa.array(place, pa.int64()))
            yield pa.RecordBatch.from_arrays([keys, *cols], names=[key, "piece_no", "begin", "end", "piece"])

    return long.mapInArrow(run, T.StructType(fields))
