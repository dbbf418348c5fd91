"""Several values packed in one field (problem 6).

A cell is a JSON or Python list, or values joined by delimiters, any of which may be quoted. Two passes:

1. ``learn``: the dictionary of known whole values. A value with a delimiter inside is known if it stands whole, in quotes or
   as an item of a list, in at least ``SUPPORT`` cells: that is told by the cells that hold it, and no other rows matter.
2. ``split_fields``: a multi-pattern automaton (Aho-Corasick) finds the dictionary's values in the unquoted part of a cell,
   and dynamic programming picks the best cover of the cell: the one with the fewest pieces, in which a known value counts as
   one piece if it fills the space between two delimiters. So delimiters inside known values do not split them.

A dictionary above ``DICTIONARY_BYTES`` is not sent to the workers; the spans of each cell are then looked up in it by a join.

Quotes count only where a value begins, and only if the closing quote is followed by a delimiter or the end; a quote
is escaped by doubling or by a backslash. Defined results: null, blank and empty-list cells give no rows; blank values
are dropped and positions count what is kept; a cell that looks like a list but is none is split as plain text; repeated
rows give repeated rows, which the callers make distinct.
"""

from __future__ import annotations

import ast
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most bytes of a dictionary that is sent to every worker.
DICTIONARY_BYTES = 16_000_000
#: Cells in which a value with a delimiter must stand whole to be known.
SUPPORT = 2


@dataclass(frozen=True)
class Style:
    """Delimiters of a field, as a pattern."""

    delimiters: str

    @property
    def pattern(self) -> re.Pattern:
        return re.compile(self.delimiters)


LABELS = Style(r"[|;,\t\r\n]")
COMMENTS = Style(r"\r?\n[ \t]*---[ \t]*(?:\r?\n|$)|\||;;+")


def as_list(cell: str) -> list[str] | None:
    """The values of a cell that is a JSON or Python list."""
    s = cell.strip()
    if not (s.startswith("[") and s.endswith("]")):
        return None
    for read in (json.loads, ast.literal_eval):
        try:
            found = read(s)
        except (ValueError, SyntaxError, RecursionError, MemoryError):
            continue
        if isinstance(found, list):
            return [x if isinstance(x, str) else json.dumps(x, ensure_ascii=False) for x in found if x is not None]
    return None


_QUOTED = {
    '"': re.compile(r'"((?:[^"\\]|\\.|"")*)"', re.S),
    "'": re.compile(r"'((?:[^'\\]|\\.|'')*)'", re.S),
}
_ESCAPED = re.compile(r"\\(.)", re.S)


def unquote(inner: str, quote: str) -> str:
    return _ESCAPED.sub(lambda m: m[1] if m[1] in "\\\"'" else m[0], inner.replace(quote * 2, quote))


@dataclass
class Token:
    begin: int
    end: int
    value: str
    quoted: bool


def tokens(cell: str, pattern: re.Pattern) -> list[Token]:
    """The pieces of a cell between delimiters that stand outside quotes."""
    out, at, n = [], 0, len(cell)
    while at <= n:
        start = at
        while start < n and cell[start].isspace() and not pattern.match(cell, start):
            start += 1
        if start < n and (q := _QUOTED.get(cell[start])) and (m := q.match(cell, start)):
            stop = m.end()
            while stop < n and cell[stop].isspace() and not pattern.match(cell, stop):
                stop += 1
            after = pattern.match(cell, stop)
            if stop == n or after:
                out.append(Token(at, stop, unquote(m[1], cell[start]).strip(), True))
                if stop == n:
                    break
                at = after.end()
                continue
        m = pattern.search(cell, start)
        stop = m.start() if m else n
        out.append(Token(at, stop, cell[at:stop].strip(), False))
        if not m:
            break
        at = max(m.end(), at + 1)
    return out


def automaton(values: list[str]):
    """An Aho-Corasick automaton over dictionary values, or None if there are none."""
    if not values:
        return None
    import ahocorasick

    a = ahocorasick.Automaton()
    for v in values:
        a.add_word(v, len(v))
    a.make_automaton()
    return a


def cover(cell: str, toks: list[Token], known) -> list[str]:
    """The values of the cover with the fewest pieces (ties: the longer first piece)."""
    if known is None or len(toks) < 2:
        return [t.value for t in toks]
    begins, ends = {}, {}
    for k, t in enumerate(toks):
        if not t.quoted:
            s = cell[t.begin : t.end]
            begins[t.begin + len(s) - len(s.lstrip())] = k
            ends[t.begin + len(s.rstrip())] = k
    spans: dict[int, list[tuple[int, str]]] = {}
    for last, size in known.iter(cell):
        i, j = begins.get(last + 1 - size), ends.get(last + 1)
        if i is not None and j is not None and j > i:
            spans.setdefault(i, []).append((j, cell[last + 1 - size : last + 1]))
    if not spans:
        return [t.value for t in toks]
    n = len(toks)
    best: list[tuple[int, int, str | None]] = [(0, 0, None)] * (n + 1)
    for i in range(n - 1, -1, -1):
        options = [(1 + best[i + 1][0], i + 1, None)]
        options += [(1 + best[j + 1][0], j + 1, v) for j, v in spans.get(i, ())]
        best[i] = min(options, key=lambda o: (o[0], -o[1]))
    out, i = [], 0
    while i < n:
        _, j, v = best[i]
        out.append(toks[i].value if v is None else v)
        i = j
    return out


def split_cell(cell: str | None, pattern: re.Pattern, known=None) -> list[str]:
    if cell is None or not cell.strip():
        return []
    found = as_list(cell)
    if found is None:
        found = cover(cell, tokens(cell, pattern), known)
    return [v for x in found if (v := x.strip())]


def learn(cells: DataFrame, column: str, style: Style, support: int = SUPPORT) -> DataFrame:
    """(val): values with a delimiter inside that stand whole, quoted or listed, in at least ``support`` cells; over all cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern = style.pattern
        for b in batches:
            out = []
            for c in b.column(0):
                c = c.as_py()
                found = as_list(c)
                whole = [t.value for t in tokens(c, pattern) if t.quoted] if found is None else found
                out += dict.fromkeys(v for x in whole if (v := x.strip()) and pattern.search(v))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["val"])

    quoted = cells.select(column).where(F.col(column).rlike("[\"']")).distinct()
    return quoted.mapInArrow(run, "val string").groupBy("val").agg(F.count("*").alias("n")).where(F.col("n") >= support).select("val")


def gathered(dictionary: DataFrame, most: int = DICTIONARY_BYTES) -> list[str] | None:
    """A dictionary of at most ``most`` bytes as a list; None for a larger one."""
    size = dictionary.agg(F.coalesce(F.sum(F.octet_length("val")), F.lit(0))).first()[0]
    return sorted(r["val"] for r in dictionary.collect()) if size <= most else None


def spans(cell: str, pattern: re.Pattern) -> list[str]:
    """Every text of a cell from the begin of one unquoted piece to the end of a later one, quoted pieces apart."""
    if as_list(cell) is not None:
        return []
    out, toks = set(), tokens(cell, pattern)
    for i, t in enumerate(toks):
        for u in toks[i + 1 :]:
            if t.quoted or u.quoted:
                break
            out.add(cell[t.begin : u.end].strip())
    return sorted(out)


def with_known(df: DataFrame, column: str, style: Style, dictionary: DataFrame, out: str) -> DataFrame:
    """Rows with the dictionary's values that occur in their cell: the way for dictionaries of any size, by a join."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern = style.pattern
        for b in batches:
            cells, vals = [], []
            for c in b.column(0):
                found = spans(c.as_py(), pattern)
                cells += [c.as_py()] * len(found)
                vals += found
            yield pa.RecordBatch.from_arrays([pa.array(cells, pa.string()), pa.array(vals, pa.string())], names=["__cell", "val"])

    cells = df.select(column).where(F.col(column).isNotNull()).distinct()
    met = cells.mapInArrow(run, "__cell string, val string").join(dictionary, "val")
    known = met.groupBy("__cell").agg(F.collect_set("val").alias(out))
    return df.join(known, df[column] == known["__cell"], "left").drop("__cell")


def split_fields(
    df: DataFrame, key: str, styles: dict[str, Style], dictionaries: dict[str, DataFrame] | None = None, most: int = DICTIONARY_BYTES
) -> DataFrame:
    """(key, field_name, pos, val), one row a value. ``pos`` counts from 1 over the kept values.

    Without dictionaries, or with such as are sent to the workers, nothing is shuffled.
    """
    sent: dict[str, list[str]] = {}
    picked = df.select(F.col(key), *[F.col(c).alias(f"__{k}") for k, c in enumerate(styles)])
    for k, c in enumerate(styles):
        none = F.lit(None).cast("array<string>").alias(f"__known{k}")
        if c in (dictionaries or {}):
            if (vals := gathered(dictionaries[c], most)) is None:
                picked = with_known(picked, f"__{k}", styles[c], dictionaries[c], f"__known{k}")
                continue
            sent[c] = vals
        picked = picked.select("*", none)
    picked = picked.select(F.col(key), *[f"__{k}" for k in range(len(styles))], *[f"__known{k}" for k in range(len(styles))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = [(c, s.pattern, automaton(sent.get(c, []))) for c, s in styles.items()]
        for b in batches:
            place, names, pos, vals = [], [], [], []
            for k, (name, pattern, known) in enumerate(ready, 1):
                for r, (cell, own) in enumerate(zip(b.column(k), b.column(k + len(ready)))):
                    at_hand = automaton(own.as_py()) if own.is_valid else known
                    for p, v in enumerate(split_cell(cell.as_py(), pattern, at_hand), 1):
                        place.append(r)
                        names.append(name)
                        pos.append(p)
                        vals.append(v)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(place, pa.int64())), pa.array(names, pa.string()), pa.array(pos, pa.int64()), pa.array(vals, pa.string())],
                names=[key, "field_name", "pos", "val"],
            )

    kind = picked.schema[key].dataType.simpleString()
    return picked.mapInArrow(run, f"`{key}` {kind}, field_name string, pos bigint, val string")


def issue_values(issues: DataFrame, support: int = SUPPORT, known: DataFrame | None = None) -> DataFrame:
    """The labels and comments of issues, distinct rows of (issue_key, field_name, pos, val).

    ``known``: (val), label values that are known to be whole beside those learnt from the cells.
    """
    styles = {"labels": LABELS, "comments": COMMENTS}
    learnt = {c: learn(issues, c, s, support) for c, s in styles.items()}
    if known is not None:
        inside = known.where(F.trim("val").rlike(LABELS.delimiters)).select(F.trim("val").alias("val"))
        learnt["labels"] = learnt["labels"].union(inside).distinct()
    return split_fields(issues, "issue_key", styles, learnt).distinct()
