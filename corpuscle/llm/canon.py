"""Problem 1: mapping freely typed values to the entries of a reference list, by BK-trees.

Entries are folded (compatibility forms, case, accents, punctuation, blanks) and indexed under the spellings people
make of them: word order changed, vowels left out of some words, a word broken off. A BK-tree over these keys under
Levenshtein distance (a true metric) returns, by the triangle inequality, every key within a radius of a folded value: first
radius 0, and if that gives no entry, the threshold. Typing errors are edits or two neighbouring characters changed over, which
are two edits in the metric. A search one edit beyond the threshold therefore finds all keys with at most one such change; keys with
more of them have nearly the same letters, and are found by a second tree over the sorted letters. Each key found is checked by
its exact number of errors. The value takes the entry of least cost (errors plus the penalty of the key's spelling), ties going to
the entry that is written like the value, then to that with the larger line number. What is within no threshold is ``unmatched``.

Distinct values are mapped, not rows, so a frequent value costs one search, and a worker keeps its trees and answers. A list with
up to ``SHARD`` keys is sent to every worker; a longer one is cut into shards of so many keys, each is sent by itself and searched
for all values, and the shards' winners are merged.

Defined results: null and blank values give no row; blanks around values and paths do not count; of repeated raw labels
in the list the last line holds; entries whose folded form is empty match only themselves; an empty list matches
nothing.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator
from itertools import permutations, product

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscle.session import spread

UNMATCHED = "unmatched"
#: Most keys of the trees in a worker; a longer list is searched in shards.
SHARD = 100_000
#: Penalties of a spelling, as parts of an edit.
ORDER, VOWELS, BROKEN, PREFIX, DIGITS = 0.3, 0.45, 0.45, 0.4, 0.1
#: Words people put before a label, with or without a separator (fixed values).
NAMESPACES = ("area", "category", "kind", "label", "prio", "priority", "scope", "state", "status", "tag", "topic", "type")
#: Characters typed for letters (fixed values).
LOOKALIKES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
_APOSTROPHES = re.compile(r"['’‘`´]")
_SHORTCODE = re.compile(r"^\s*:[a-z0-9_+-]+:\s*", re.I)
_WORD = re.compile(r"[^\W_]+")
_BROKEN = re.compile(r"[^\W\d_]{2,}[^\w\s]*\.(?=s?\b|\s|\W*$)")
_MIXED = re.compile(r"(?=[^\W_]*[^\W\d_])(?=[^\W_]*\d|\S*[@$])[^\W_@$]*[@$\d][^\W_]*")
_PREFIX = re.compile(r"^\W*[^\W_]+(?:\s+-+\s+|\s*[/:|]+\s*)(?=\S)")
_VOWELS = re.compile(r"[aeiou]")


def tidy(s: str) -> str:
    """Compatibility form, lower case, no accents, apostrophes, symbols or leading shortcodes."""
    s = unicodedata.normalize("NFKD", s)
    s = "".join(c for c in s if not unicodedata.combining(c) and unicodedata.category(c) not in ("So", "Cf", "Cs", "Co"))
    return _APOSTROPHES.sub("", _SHORTCODE.sub("", s.casefold()))


def words(s: str) -> list[str]:
    return _WORD.findall(tidy(s))


def levenshtein(a: str, b: str) -> int:
    """Edit distance by bit vectors (Myers 1999, Hyyrö 2003); Python integers hold any length."""
    if a == b:
        return 0
    if not a or not b:
        return len(a) or len(b)
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    m = len(a)
    full, top = (1 << m) - 1, 1 << m - 1
    plus, minus, score = full, 0, m
    for c in b:
        eq = at.get(c, 0)
        x = eq | minus
        y = (((eq & plus) + plus) ^ plus) | eq
        hp = minus | ~(y | plus) & full
        hm = plus & y
        if hp & top:
            score += 1
        elif hm & top:
            score -= 1
        hp = (hp << 1 | 1) & full
        plus = (hm << 1 & full) | ~(x | hp) & full
        minus = hp & x
    return score


def typing_distance(a: str, b: str) -> int:
    """Levenshtein distance in which two neighbouring characters may also change places (each only once)."""
    n, m = len(a), len(b)
    last, row = None, list(range(m + 1))
    for i in range(1, n + 1):
        new = [i] + [0] * m
        for j in range(1, m + 1):
            d = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (a[i - 1] != b[j - 1]))
            if last is not None and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d = min(d, last[j - 2] + 1)
            new[j] = d
        last, row = row, new
    return row[m]


class BKTree:
    """Keys under a metric; ``within`` returns every key at most k away."""

    def __init__(self, keys):
        self.root: tuple[str, dict] | None = None
        for k in keys:
            self.add(k)

    def add(self, key: str) -> None:
        if self.root is None:
            self.root = (key, {})
            return
        node = self.root
        while True:
            d = levenshtein(node[0], key)
            if d == 0:
                return
            if (child := node[1].get(d)) is None:
                node[1][d] = (key, {})
                return
            node = child

    def within(self, key: str, k: int) -> list[tuple[int, str]]:
        found, todo = [], [self.root] if self.root else []
        while todo:
            own, children = todo.pop()
            d = levenshtein(own, key)
            if d <= k:
                found.append((d, own))
            todo += [c for e, c in children.items() if d - k <= e <= d + k]
        return found


def threshold(n: int) -> int:
    """Typing errors allowed to a key of n characters; trees are searched one edit further, then checked exactly."""
    return 0 if n < 3 else 1 if n < 5 else 2 if n < 10 else 3


def spellings(entry: str) -> dict[str, tuple[float, str]]:
    """Key to (penalty, kind) of the spellings under which an entry is indexed; the least penalty of each key."""
    ws = words(entry)
    out: dict[str, tuple[float, str]] = {}

    def put(key: str, penalty: float, kind: str) -> None:
        if key and (key not in out or penalty < out[key][0]):
            out[key] = (penalty, kind)

    if len(ws) <= 3:
        orders = list(permutations(range(len(ws))))
    else:
        n = len(ws)
        orders = [tuple(range(n))] + [tuple((i + k) % n for i in range(n)) for k in range(1, n)] + [tuple(range(n))[::-1]]
    bare = [w[:1] + _VOWELS.sub("", w[1:]) if len(w) > 2 else w for w in ws]
    for order in dict.fromkeys(orders):
        moved = ORDER if list(order) != sorted(order) else 0.0
        put("".join(ws[i] for i in order), moved, "whole")
        if len(ws) <= 5:
            for drop in product((False, True), repeat=len(ws)):
                if any(drop):
                    put("".join(bare[i] if drop[i] else ws[i] for i in order), moved + VOWELS, "bare")
        for k, w in enumerate(ws):
            for n in range(2, len(w)):
                put("".join(ws[i][:n] if i == k else ws[i] for i in order), moved + BROKEN, "broken")
    if len(ws) > 1:
        for n in range(3, len(ws[0]) + 1):
            put(ws[0][:n], 2 * BROKEN, "broken")
    return out


class Mapper:
    """The entries of a list, or of a shard of it."""

    _made: dict[bytes, Mapper] = {}

    @classmethod
    def of(cls, entries: list[tuple[int, str, str]]) -> Mapper:
        """The worker's mapper of these entries; the last one made is kept, as many tasks ask for it."""
        key = hashlib.md5(repr(entries).encode("utf-8", "surrogatepass")).digest()
        if key not in cls._made:
            cls._made = {key: cls(entries)}
        return cls._made[key]

    def __init__(self, entries: list[tuple[int, str, str]]):
        self.answers: dict[tuple[str, bool], list] = {}
        self.exact: dict[str, tuple[int, str]] = {}
        self.keys: dict[str, list[tuple[float, int, str, str]]] = {}
        for line, raw, path in entries:
            raw, path = raw.strip(), path.strip()
            if raw not in self.exact or line >= self.exact[raw][0]:
                self.exact[raw] = (line, path)
        for raw, (line, path) in self.exact.items():
            for key, (penalty, kind) in spellings(raw).items():
                self.keys.setdefault(key, []).append((penalty, line, path, kind))
        plain = [k for k, v in self.keys.items() if any(kind != "broken" for *_, kind in v)]
        self.longest = max(map(len, self.keys), default=0)
        self.tree, self.broken = BKTree(plain), BKTree([k for k, v in self.keys.items() if any(x[3] == "broken" for x in v)])
        self.sorted: dict[str, list[str]] = {}
        for k in plain:
            self.sorted.setdefault("".join(sorted(k)), []).append(k)
        self.letters = BKTree(self.sorted)

    def views(self, raw: str) -> list[tuple[str, float, bool]]:
        """(folded key, penalty, whether a word is marked as broken off) of a typed value."""
        s = tidy(raw)
        ws = _WORD.findall(s)
        # no key is within reach of a far longer value, with or without its first word
        sizes = [sum(map(len, ws)), sum(map(len, ws[1:]))]
        if not ws or min(n for n in sizes if n) > self.longest + threshold(self.longest):
            return []
        marked = bool(_BROKEN.search(s))
        texts = [(s, 0.0)]
        if len(ws) > 1:
            m = _PREFIX.match(s)
            if m or ws[0] in NAMESPACES:
                texts.append((s[m.end() :] if m else s[s.index(ws[0]) + len(ws[0]) :], PREFIX))
        out: dict[str, float] = {}
        for text, penalty in texts:
            keys = [("".join(_WORD.findall(text)), penalty)]
            if _MIXED.search(text):
                for one in ("i", "l"):
                    typed = _MIXED.sub(lambda w: "".join({**LOOKALIKES, "1": one}.get(c, c) for c in w[0]), text)  # noqa: B023
                    keys.append(("".join(_WORD.findall(typed)), penalty + DIGITS))
            for key, p in keys:
                if key and (p == 0.0 or len(key) > 2):
                    out.setdefault(key, p)
        return [(key, p, marked) for key, p in out.items()]

    def near(self, key: str, marked: bool) -> list[tuple[int, str, tuple[str, ...]]]:
        """(errors, key of an entry, the kinds of spelling that count) of all keys within the threshold."""
        if (known := self.answers.get((key, marked))) is not None:
            return known
        whole = ("whole", "bare")
        kinds = (*whole, "broken") if marked or len(key) >= 8 else whole
        same = [0 for _ in self.tree.within(key, 0)] + [0 for _ in self.broken.within(key, 0) if "broken" in kinds]
        found = [(0, key, kinds)] if same else []
        k = threshold(len(key))
        if k and len(key) <= self.longest + k and not any(x[3] in kinds for _ in found for x in self.keys[key]):
            met = {n: (d, whole) for d, n in self.tree.within(key, k + 1)}
            if k > 1:
                # two changes of neighbours are four edits: but at most k - 2 other errors, each of two edits in sorted letters
                for _, letters in self.letters.within("".join(sorted(key)), 2 * (k - 2)):
                    met |= {n: (k, whole) for n in self.sorted[letters] if n not in met}
            if marked:
                met |= {n: (d, ("broken",) if n not in met else (*whole, "broken")) for d, n in self.broken.within(key, k)}
            for n, (d, of) in met.items():
                d = d if d < 2 else typing_distance(key, n)
                if 0 < d <= threshold(min(len(key), len(n))):
                    found.append((d, n, of))
        if len(self.answers) > 200_000:
            self.answers.clear()
        self.answers[key, marked] = found
        return found

    def best(self, raw: str) -> tuple[float, int, str] | None:
        """(cost, line, path) of the entry a value means."""
        found: tuple[float, int, str] | None = None
        for key, penalty, marked in self.views(raw):
            if found is not None and found[0] < 1:
                break
            for d, near, kinds in self.near(key, marked):
                for extra, line, path, kind in self.keys[near]:
                    if kind in kinds and (kind == "whole" or d <= threshold(len(near)) - 1):
                        option = (d + penalty + extra, line, path)
                        if found is None or (option[0], -option[1]) < (found[0], -found[1]):
                            found = option
        # the entry that is written just so, also if it folds to nothing
        if (e := self.exact.get(raw.strip())) is not None:
            return (0.0, e[0], e[1])
        return found


def _entries(mapping: DataFrame, raw: str, path: str, line: str) -> DataFrame:
    return mapping.where(F.col(raw).isNotNull() & (F.trim(raw) != "")).select(
        F.coalesce(F.col(line).cast("long"), F.lit(-1)).alias("line"), F.col(raw).alias("raw"), F.coalesce(path, F.lit("")).alias("path")
    )


def shards(entries: DataFrame, most: int) -> list[DataFrame]:
    """The entries in parts of about ``most`` keys, by a hash; the keys are counted on the cluster."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sum(len(spellings(x.as_py().strip())) + 1 for x in b.column(0))], pa.int64())], names=["n"])

    keys = entries.select("raw").mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0
    n = max(1, -(-keys // most))
    # equal raw labels are in one part, as the last line of them holds
    part = F.pmod(F.xxhash64(F.trim("raw")), F.lit(n))
    return [entries] if n == 1 else [entries.where(part == i) for i in range(n)]


def map_values(
    typed: DataFrame, mapping: DataFrame, value_col: str = "raw_label", raw_col: str = "raw_label",
    path_col: str = "normalized_path", line_col: str = "line_no", shard: int = SHARD,
) -> DataFrame:
    """(value, normalized_path, cost): one row for each distinct non-blank value; unmatched values have a null cost."""
    entries = _entries(mapping, raw_col, path_col, line_col)
    values = typed.select(F.col(value_col).alias("value")).where("value is not null").distinct()
    # few small rows, much work for each; values that fold alike go to one worker, which searches once
    like = F.regexp_replace(F.lower("value"), r"[^\p{L}\p{N}]+", "")
    values = values.repartition(4 * spread(typed), like)
    schema, spark, found = "value string, cost double, line long, path string", typed.sparkSession, None
    parts = shards(entries, shard)
    for part in parts:
        sent = spark.sparkContext.broadcast([tuple(r) for r in part.orderBy("line", "raw", "path").collect()])

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            mapper = Mapper.of(sent.value)
            for b in batches:
                vals = [v for x in b.column(0) if (v := x.as_py()).strip()]
                best = [mapper.best(v) or (None, None, None) for v in vals]
                cols = [pa.array([x[k] for x in best], t) for k, t in enumerate((pa.float64(), pa.int64(), pa.string()))]
                yield pa.RecordBatch.from_arrays([pa.array(vals, pa.string()), *cols], names=["value", "cost", "line", "path"])

        one = values.mapInArrow(run, schema)
        found = one if found is None else found.union(one)
    if len(parts) > 1:
        best = F.min(F.when(F.col("cost").isNotNull(), F.struct("cost", (-F.col("line")).alias("l"), "path"))).alias("b")
        found = found.groupBy("value").agg(best).select("value", "b.cost", (-F.col("b.l")).alias("line"), "b.path")
    return found.select("value", F.coalesce("path", F.lit(UNMATCHED)).alias("normalized_path"), "cost")


def map_rows(typed: DataFrame, mapping: DataFrame, key: str = "typed_id", value_col: str = "raw_label", **cols) -> DataFrame:
    """Distinct (key, normalized_path) of the rows whose value is neither null nor blank."""
    rows = typed.select(F.col(key), F.col(value_col).alias("value"))
    return rows.join(map_values(typed, mapping, value_col, **cols), "value").select(key, "normalized_path").distinct()


def unmatched(typed: DataFrame, mapping: DataFrame, value_col: str = "raw_label", **cols) -> DataFrame:
    """(value, n_rows): the values that mean no entry, with the rows that have them."""
    counts = typed.groupBy(F.col(value_col).alias("value")).agg(F.count("*").alias("n_rows"))
    mapped = map_values(typed, mapping, value_col, **cols).where(F.col("normalized_path") == UNMATCHED)
    return counts.join(mapped.select("value"), "value")
