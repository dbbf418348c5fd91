"""Problem 10: texts that lost their end.

A backward character n-gram model: for the last n characters before a place of a text, read backward, it knows how often
texts and lines stop there without a closing mark and how often they go on, per language and column. For the end of a
text the longest known context gives the log-odds of stopping, which is compared with the log-odds of any place of the same
language and column; an end at which texts go on nearly as at any other place, and do not stop by far more often, was cut.

Training is two passes over every distinct text; texts that are equal count once, in stops and in goings-on. The first counts the contexts of all open stops (ends of texts and lines without
a closing mark) and keeps all of at most ``SHORT`` characters, whose number the alphabet bounds, and the longer ones of at
least ``LEAST`` stops and one in ``ONE_IN`` of the stops of their language and column, which bounds theirs; complete endings
without a mark recur, while cuts fall anywhere. The second counts at every place of every text whether a kept context goes on. Each task sends one compressed count vector over the kept contexts. One more kind of
context is the first word of the last sentence: sentences that begin so may as a rule have no closing mark.

Texts that were cut and then copied with changes end alike as complete texts with a common last line do. They differ in
what stands before: an ending of ``WIDE`` characters recurs, and counts at each of its stops, if at least ``LEAST``
different texts of ``FAR`` characters end so or if at least some ``MANY`` differently beginning texts have it; else it
counts once.

What was put after a cut (an ellipsis, a hyphen, "[more]", a broken character) is taken off first; an ellipsis or hyphen
only if sentences with that first word do not end so as a rule. Two further signs lower the threshold: a text as long as a field limit of its
source (a size that far more texts share than the sizes around it, and a large part of all texts of at least that
size), and a code block that is never closed.

Defined results: null and blank texts are no cases; a text that ends with a sentence mark is complete; case and digits
do not count; without any known context only the further signs count; empty tables give no rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lengths of contexts; least stops of a kept context; a kept context has at least one in ONE_IN of the stops of its language
#: and column. Both are for contexts of more than SHORT characters.
ORDERS, LEAST, ONE_IN = (2, 3, 4, 5, 6, 8, 10, 13), 3, 300_000
#: Ends that are the same over WIDE characters come from copies, unless they differ over FAR characters or their texts begin
#: with MANY (as counted in 64 bits) different runs of WIDE characters.
WIDE, FAR, MANY = 40, 200, 16
#: Contexts of at most SHORT characters are kept whatever their stops; they are believed from so many places on.
SHORT, SUPPORT = 3, 20
#: A text is cut if its log-odds of stopping are below those of any place of its language and column plus these: as a rule; at
#: a field limit or in an open code block; in a sentence that begins as open ones do; after something that may be, or always is, put
#: after cuts.
ODDS, ODDS_SIGNS, ODDS_OPEN, ODDS_MARKED, ODDS_SURE = 2.65, 5.35, 0.05, 4.55, 7.0
#: From this part of sentences without closing mark on, a first word makes open sentences.
OPEN = 0.4
#: Marks and encoded data are looked for in so many last characters; the lines before the last one are passed on as far as they
#: touch as many. White space as Python has it.
END = 1000
BLANKS = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
#: Parts of the count vector that are summed separately, and tasks whose vectors are summed at once.
PARTS, GROUP = 16, 256
#: What is put after a cut (fixed values): the first kind always, the second only if such sentences do not end so as a rule.
SURE = r"\s*(?:\[(?:more|cut|truncated|read more|\.\.\.|…)\]|\((?:more|cut|truncated|\.\.\.|…)\))|\s*…|�+"
MAYBE = r"\s*\.\.\.+|[-‐–—]+"
_SURE, _MAYBE = re.compile(f"(?:{SURE})\\s*$", re.I), re.compile(f"(?:{MAYBE})\\s*$")
MARK_SQL = f"(?i)(?:{SURE}|{MAYBE})\\s*$"
CLOSED = re.compile(r"(?:[.?!]|[。！？｡])[\"'”’»)\]）」』*_]*$")
_DIGITS, _CODE, _URL = re.compile(r"\d"), re.compile(r"`[^`\n]{1,80}`"), re.compile(r"https?://\S+")
_FIRST = re.compile(r"(?:^|(?<=[.?!]\s)|(?<=[。！？])|(?<=\n))[^\s]+")
#: An end that is no text (encoded data); there is no word or sentence it could stop inside.
_NO_WORD = re.compile(r"[!-~]{60,}$")
U = np.uint64


def language(lang: Column) -> Column:
    """The leading code of a language field; null if there is none."""
    return F.nullif(F.lower(F.regexp_extract(lang, r"^\s*([A-Za-z]+)", 1)), F.lit(""))


def normal(text: str) -> str:
    """Digits, identifiers in backticks and addresses do not count; carriage returns are line ends."""
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    return _DIGITS.sub("0", _URL.sub("url", _CODE.sub("`w`", text)))


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)


def _seed(lang: str, column: str) -> int:
    return zlib.crc32(f"{column}|{lang}".encode()) << 16


def _any_key(seed: np.ndarray) -> np.ndarray:
    """The key of a language and column: the context of no characters, which every place has."""
    with np.errstate(over="ignore"):
        return _marked((seed + U(1)) * U(0x9E3779B97F4A7C15), 1)


def _word_key(word: str, lang: str, column: str) -> int:
    """The key of a first word; case counts here."""
    w = word[:24]
    return int.from_bytes(zlib.crc32(w.encode("utf-8", "replace")).to_bytes(4, "big") + zlib.crc32(f"{w}|{column}|{lang}".encode("utf-8", "replace")).to_bytes(4, "big"), "big", signed=True) | 1


def _marked(h: np.ndarray, order: int) -> np.ndarray:
    """Keys of contexts are even; the second bit tells short ones."""
    k = (h * U(0xD6E8FEB86659FD93)) & ~U(3)
    return (k | U(2) if order <= SHORT else k).view(np.int64)


def context_keys(codes: np.ndarray, seeds: np.ndarray, at: np.ndarray, wide: bool = False) -> Iterator[np.ndarray]:
    """For each order, and with ``wide`` for WIDE characters, the keys of the contexts that end at ``at``; even numbers.

    ``codes`` must begin with more line ends than the longest context has characters.
    """
    h = seeds[at].copy()
    with np.errstate(over="ignore"):
        for k in range(WIDE if wide else ORDERS[-1]):
            h ^= codes[at - k]
            h *= U(0x9E3779B97F4A7C15)
            h ^= h >> U(29)
            if k + 1 in ORDERS or k + 1 == WIDE:
                yield _marked(h, k + 1)


def count_contexts(codes: np.ndarray, seeds: np.ndarray, wanted: np.ndarray, add) -> None:
    """Give ``add`` the keys of the contexts that end at the wanted places, order by order; it tells which of them are kept.

    A longer context is kept only if the shorter ones in it are, so only places with a kept context go on to the next order.
    """
    at = np.flatnonzero(wanted)
    h = seeds[at]
    with np.errstate(over="ignore"):
        for k in range(ORDERS[-1]):
            h ^= codes[at - k]
            h *= U(0x9E3779B97F4A7C15)
            h ^= h >> U(29)
            if k + 1 in ORDERS:
                kept = add(_marked(h, k + 1))
                at, h = at[kept], h[kept]


class Block:
    """Some texts as one array of characters, with their stops."""

    def __init__(self, texts: list[tuple[str, str, str]]):
        lead = "\n" * (WIDE + 1)
        plain = [lead + normal(t).rstrip() + "\n" for t, _, _ in texts]
        parts = [_codes(p.casefold()) for p in plain]
        self.codes = np.concatenate(parts)
        self.seeds = np.repeat(np.array([_seed(x, c) for _, x, c in texts], np.uint64), [len(p) for p in parts])
        after = np.append(self.codes[1:], U(10))
        self.stops = (after == U(10)) & (self.codes != U(10))
        self.goes_on = ~self.stops & (self.codes != U(10))
        self.goes_on[:WIDE] = False
        self.texts, self.plain = texts, plain
        marks = np.array([ord(c) for c in ".?!。！？｡"], np.uint64)
        dots = (self.codes == U(46)) & (np.append(U(0), self.codes[:-1]) == U(46))
        self.open_stops = np.flatnonzero(self.stops & (dots | ~np.isin(self.codes, marks)))
        self.ends = np.cumsum([len(p) for p in parts])

    def evidence(self) -> tuple[np.ndarray, np.ndarray]:
        """For each open stop the hash of the FAR characters that end there and a bit for the beginning of its text."""
        import xxhash

        hashed, raw = xxhash.xxh3_64_intdigest, memoryview(self.codes).cast("B")
        begins = np.append(0, self.ends[:-1]) + WIDE + 1
        bits = np.array([1 << (hashed(raw[8 * a : 8 * min(a + WIDE, b)]) & 63) for a, b in zip(begins, self.ends)], np.uint64)
        text = np.searchsorted(self.ends, self.open_stops, "right")
        starts = np.maximum(begins[text], self.open_stops - FAR + 1)
        far = [hashed(raw[8 * a : 8 * b]) for a, b in zip(starts.tolist(), (self.open_stops + 1).tolist())]
        return np.array(far, np.uint64).view(np.int64), bits[text].view(np.int64)

    def starts(self) -> np.ndarray:
        """Keys of the first words of all sentences."""
        return np.array([_word_key(w, x, c) for (_, x, c), p in zip(self.texts, self.plain) for w in _FIRST.findall(p)], np.int64)

    def open_starts(self) -> np.ndarray:
        """Keys of the first words of the last sentences of lines without a closing mark, each with its text's seed."""
        found = [
            (_word_key(f[-1], x, c), _seed(x, c))
            for (_, x, c), p in zip(self.texts, self.plain)
            for line in map(str.rstrip, p.split("\n"))
            if line and (line.endswith("..") or not CLOSED.search(line)) and (f := _FIRST.findall(line))
        ]
        return np.array(found, np.int64).reshape(-1, 2)


def _blocks(batches: Iterator[pa.RecordBatch], chars: int = 50_000) -> Iterator[Block]:
    held, size = [], 0
    for b in batches:
        for t, lang, col in zip(*(b.column(k) for k in range(3))):
            if (t := t.as_py()) and not t.isspace():
                held.append((t, lang.as_py(), col.as_py()))
                size += len(t)
                if size >= chars:
                    yield Block(held)
                    held, size = [], 0
    if held:
        yield Block(held)


def distinct_texts(rows: DataFrame) -> DataFrame:
    """(txt, lang, col) without copies; copies are dropped before they are shuffled where they meet."""
    same = [F.xxhash64("txt").alias("h"), F.xxhash64(F.lit(1), F.col("txt")).alias("i")]
    return rows.groupBy("lang", "col", *same).agg(F.first("txt").alias("txt")).select("txt", "lang", "col")


def train(rows: DataFrame) -> bytes:
    """The model: kept keys with their stops and goings-on, compressed. ``rows`` has (txt, lang, col)."""
    rows = distinct_texts(rows)

    def stops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _blocks(batches):
            found = [_any_key(x.seeds[x.open_stops]), *context_keys(x.codes, x.seeds, x.open_stops, wide=True)]
            far, bits = x.evidence()
            order = np.lexsort((far, found[-1]))
            wide, far = found[-1][order], far[order]
            first = np.flatnonzero(np.append(True, (wide[1:] != wide[:-1]) | (far[1:] != far[:-1]))[: len(wide)])
            keys = np.stack([f[order[first]] for f in found[:-1]], axis=1)
            starts = x.open_starts()
            words, at, n = np.unique(starts[:, 0], return_index=True, return_counts=True)
            # one row an end with its contexts, and one row a first word
            sizes = np.concatenate([np.full(len(keys), keys.shape[1]), np.ones(len(words), np.int64)])
            ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            ks = pa.ListArray.from_arrays(ends, pa.array(np.concatenate([keys.reshape(-1), words])))
            none = np.zeros(len(words), np.int64)
            columns = {
                "is_end": np.arange(len(sizes)) < len(keys), "x": np.concatenate([wide[first], words]), "far": np.concatenate([far[first], none]),
                "begins": np.concatenate([np.bitwise_or.reduceat(bits[order], first) if len(first) else none[:0], none]),
                "n": np.concatenate([np.diff(np.append(first, len(wide))), n]), "ks": ks,
                "s": np.concatenate([x.seeds[x.open_stops][order[first]].view(np.int64), starts[at, 1]]),
            }
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns.values()], names=list(columns))

    found = rows.mapInArrow(stops, "is_end boolean, x long, far long, begins long, n long, ks array<long>, s long")
    same = [F.first("ks").alias("ks"), F.first("s").alias("s"), F.sum("n").alias("n"), F.bit_or("begins").alias("begins")]
    both = found.groupBy("is_end", "x", "far").agg(*same).groupBy("is_end", "x").agg(*same, F.count("*").alias("fars"))
    recurs = ~F.col("is_end") | (F.col("fars") >= LEAST) | (F.bit_count("begins") >= MANY)
    both = both.select("is_end", "ks", "s", F.when(recurs, F.col("n")).otherwise(1).cast("long").alias("n"))
    counted = both.select(F.explode("ks").alias("k"), "s", "n")
    counted = counted.groupBy("k").agg(F.sum("n").alias("n"), F.first("s").alias("s"))
    short = F.col("k").bitwiseAND(3) == 2
    # a bound: each order has every stop once, so at most ONE_IN contexts of an order reach the share; the total is taken over
    # the short orders, without a filter, as then the counts are made once for both sides of the join
    totals = counted.groupBy("s").agg((F.sum(F.when(short, F.col("n")).otherwise(0)) / (1 + sum(n <= SHORT for n in ORDERS))).alias("total"))
    kept = counted.where((F.col("n") >= LEAST) | short).join(F.broadcast(totals), "s")
    table = kept.where(short | (F.col("n") * ONE_IN >= F.col("total"))).select("k", "n").toArrow()
    keys = table.column("k").to_numpy()
    order = np.argsort(keys)
    keys, n_stops = keys[order], table.column("n").to_numpy()[order]
    if not len(keys):
        return b""
    packed = zlib.compress(keys.tobytes(), 1)
    sent = rows.sparkSession.sparkContext.broadcast(packed)

    def goings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.frombuffer(zlib.decompress(sent.value), np.int64)
        maybe = np.zeros(1 << 22, bool)  # most places have no kept context; this tells cheaply
        maybe[(own >> 5) & (len(maybe) - 1)] = True
        counts = np.zeros(len(own), np.int64)

        def add(found: np.ndarray) -> np.ndarray:
            """Count the keys that are kept, and tell which those are."""
            kept = np.flatnonzero(maybe[(found >> 5) & (len(maybe) - 1)])
            i = np.minimum(np.searchsorted(own, found[kept]), len(own) - 1)
            same = own[i] == found[kept]
            np.add.at(counts, i[same], 1)
            return kept[same]

        for x in _blocks(batches):
            count_contexts(x.codes, x.seeds, x.goes_on, add)
            add(_any_key(x.seeds[x.goes_on]))
            add(x.starts())
        blobs = [zlib.compress(p.tobytes(), 1) for p in np.array_split(counts, PARTS)]
        group = TaskContext.get().partitionId() // GROUP
        columns = [pa.array(range(PARTS), pa.int32()), pa.array([group] * PARTS, pa.int32()), pa.array(blobs, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["part", "grp", "c"])

    def summed(group: pa.Table) -> pa.Table:
        out = sum(np.frombuffer(zlib.decompress(c.as_py()), np.int64) for c in group.column("c"))
        return pa.table({"part": group.column("part")[:1], "grp": group.column("grp")[:1], "c": pa.array([zlib.compress(out.tobytes(), 1)], pa.binary())})

    # a tree of sums, so that no group has more than GROUP vectors, or at the end one for every GROUP tasks
    kind = "part int, grp int, c binary"
    groups = rows.mapInArrow(goings, kind).groupBy("part", "grp").applyInArrow(summed, kind)
    parts = groups.groupBy("part").applyInArrow(summed, kind).collect()
    on = np.concatenate([np.frombuffer(zlib.decompress(bytes(r["c"])), np.int64) for r in sorted(parts, key=lambda r: r["part"])])
    return zlib.compress(np.stack([keys, n_stops, on]).tobytes(), 1)


class Model:
    """A trained model in a worker."""

    def __init__(self, packed: bytes):
        self.keys, self.stop, self.on = np.frombuffer(zlib.decompress(packed), np.int64).reshape(3, -1) if packed else np.zeros((3, 0), np.int64)

        self.bases: dict[int, float] = {}

    def base(self, lang: str, column: str) -> float:
        """Log-odds of stopping at any place of a language and column."""
        seed = _seed(lang, column)
        if seed not in self.bases:
            i = self._at(int(_any_key(np.array([seed], np.uint64))[0]))
            self.bases[seed] = 0.0 if i is None else float(np.log((int(self.stop[i]) + 0.1) / (int(self.on[i]) + 1.0)))
        return self.bases[seed]

    def _at(self, key: int) -> int | None:
        i = int(np.searchsorted(self.keys, key))
        return i if i < len(self.keys) and self.keys[i] == key else None

    def odds(self, text: str, lang: str, column: str, own: int) -> float | None:
        """Log-odds of stopping at this end, by the longest context known; ``own`` stops are left out of the counts."""
        text, at = text.replace("\r\n", "\n").replace("\r", "\n"), len(text) - ORDERS[-1]
        while True:  # whole lines, as addresses and code are folded within lines
            at = text.rfind("\n", 0, max(0, at))
            tail = normal(text[at + 1 :]).rstrip()
            if at < 0 or len(tail) > ORDERS[-1]:
                break
        codes = _codes("\n" * (ORDERS[-1] + 1) + tail.casefold())
        seeds = np.full(len(codes), _seed(lang, column), np.uint64)
        for k in reversed([int(x[0]) for x in context_keys(codes, seeds, np.array([len(codes) - 1]))]):
            if (i := self._at(k)) is None:
                continue
            stop, on = int(self.stop[i]) - own, int(self.on[i])
            if stop >= LEAST - 1 or (k & 3 == 2 and stop + on >= SUPPORT):
                return float(np.log((max(0, stop) + 0.1) / (on + 1.0)))
        return None

    def opens(self, text: str, lang: str, column: str) -> float:
        """The part of the sentences with this last sentence's first word that have no closing mark."""
        first = _FIRST.findall(normal(text).rstrip().rsplit("\n", 1)[-1])
        if not first or (i := self._at(_word_key(first[-1], lang, column))) is None:
            return 0.0
        return max(0.0, (int(self.stop[i]) - 1) / max(1, int(self.on[i]) - 1))

    def cut(self, text: str | None, lang: str, column: str, signs: bool) -> bool:
        """Whether a text was cut; of a long text, what :func:`tail` leaves is enough."""
        if text is None or not (whole := text.rstrip()):
            return False
        text = whole[-END:]
        sure, maybe, base = _SURE.search(text), _MAYBE.search(text), self.base(lang, column)
        if not sure and not maybe and CLOSED.search(text) and not re.search(r"\d\.$", text):
            return False
        if sure or maybe:
            if not sure and self.opens(whole, lang, column) >= OPEN:
                return False  # such sentences as a rule end so
            bare = whole[: len(whole) - len(text) + (sure or maybe).start()].rstrip()
            if not bare or CLOSED.search(bare[-END:]):
                return False
            inner = self.odds(bare, lang, column, 0)
            return inner is None or inner < base + (ODDS_SURE if sure else ODDS_MARKED)
        own = self.odds(whole, lang, column, 1)
        if own is None or _NO_WORD.search(text):
            return signs
        if signs:
            return own < base + ODDS_SIGNS
        return own < base + (ODDS_OPEN if self.opens(whole, lang, column) >= OPEN else ODDS)


def tail(text: Column) -> Column:
    """The end of a text without white space after it: the whole last line and whole lines over END characters before it."""
    t = F.when(F.right(text, F.lit(1)).isin(*BLANKS), F.rtrim(text, F.lit(BLANKS))).otherwise(text)
    n = F.char_length(F.substring_index(t, "\n", -1)) + END
    return F.concat(F.substring_index(F.left(t, F.char_length(t) - n), "\n", -1), F.right(t, n))


def bare_length(text: Column) -> Column:
    """Characters of a text without white space at its end and what was put after a cut."""
    blanks = F.lit(" \t\r\n\u00a0\u3000")
    t = F.rtrim(text, blanks)
    end = F.right(t, F.lit(64))  # longer than any mark
    return F.char_length(t) - F.char_length(end) + F.char_length(F.rtrim(F.regexp_replace(end, MARK_SQL, ""), blanks))


def limits(docs: DataFrame, text_col: str = "text", source_col: str = "source", least: int = 8, times: float = 6.0, part: float = 0.15) -> DataFrame:
    """(source, unit, size, n): field limits of sources, in characters or UTF-8 bytes.

    A size is a limit if at least ``least`` texts of the source have it, ``times`` as many as the sizes around it on
    average, and these are ``part`` of all texts of the source of that size or more. Texts are counted as they are and
    without what was put after a cut. Only counts by (source, unit, size) are compared.
    """
    size = lambda unit, s: F.struct(F.lit(unit).alias("unit"), s.alias("size"))
    sizes = F.array_distinct(F.array(
        size("chars", F.char_length(text_col)), size("chars", bare_length(F.col(text_col))), size("bytes", F.octet_length(text_col))
    ))
    sized = docs.where(F.col(text_col).isNotNull()).select(F.col(source_col).alias("source"), F.explode(sizes).alias("u"))
    sized = sized.where("u.size > 0").groupBy("source", "u.unit", "u.size").agg(F.count("*").alias("n"))
    often = sized.where(F.col("n") >= least)
    near = often.select("source", "unit", "size", "n", F.explode(F.sequence(F.col("size") - 28, F.col("size") + 20)).alias("other"))
    other = sized.select("source", "unit", F.col("size").alias("other"), F.col("n").alias("m"))
    gap = F.col("other") - F.col("size")
    usual = F.coalesce(F.sum(F.when((gap < -8) | (gap > 8), F.col("m"))), F.lit(0)) / 32.0
    spikes = near.join(other, ["source", "unit", "other"], "left").groupBy("source", "unit", "size", "n").agg(usual.alias("usual"))
    spikes = spikes.where(F.col("n") >= times * (F.col("usual") + 0.3))
    # how many texts are at least as long: few spikes against the counts of their source
    longer = spikes.join(other, ["source", "unit"]).where("other >= size").groupBy("source", "unit", "size", "n").agg(F.sum("m").alias("longer"))
    return longer.where(F.col("n") >= part * F.col("longer")).select("source", "unit", "size", "n")


def judged(docs: DataFrame) -> DataFrame:
    """(doc_id, source, lang, is_cut, signs): one row a document with a text."""
    langs = docs.select(language(F.col("lang")).alias("l")).where("l is not null").groupBy("l").agg(F.count("*").alias("n"))
    most = langs.orderBy(F.desc("n"), "l").first()  # stands for texts without a language
    lang = F.coalesce(language(F.col("lang")), F.lit(most["l"] if most else ""))
    has_main = F.trim(F.coalesce(F.col("main_text"), F.lit(""))) != ""
    rows = docs.where(has_main).select(F.col("main_text").alias("txt"), lang.alias("lang"), F.lit("main_text").alias("col")).union(
        docs.where("title is not null").select(F.col("title").alias("txt"), lang.alias("lang"), F.lit("title").alias("col"))
    )
    packed = train(rows)
    sent = docs.sparkSession.sparkContext.broadcast(packed)
    known = limits(docs).groupBy("source").agg(
        F.collect_set(F.when(F.col("unit") == "chars", F.col("size"))).alias("chars"),
        F.collect_set(F.when(F.col("unit") == "bytes", F.col("size"))).alias("bytes"),
    )
    fences = F.size(F.split("text", "(?m)^```|(?<=\\s)```")) % 2 == 0
    asked = docs.where(F.col("text").isNotNull()).select(
        "doc_id", "source", lang.alias("lang"), tail(F.col("text")).alias("text"), F.when(has_main, "main_text").otherwise("title").alias("col"),
        F.char_length("text").alias("n"), bare_length(F.col("text")).alias("m"), F.octet_length("text").alias("b"), fences.alias("fences"),
    )
    at = F.array_contains("chars", F.col("n")) | F.array_contains("chars", F.col("m")) | F.exists(
        "bytes", lambda x: F.col("b").between(x - 3, x)
    )
    asked = asked.join(known, "source", "left").select(
        "doc_id", "source", "lang", "text", "col", (F.coalesce(at, F.lit(False)) | F.col("fences")).alias("signs")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(sent.value)
        for b in batches:
            x = b.to_pydict()
            cut = [model.cut(*r) for r in zip(x["text"], x["lang"], x["col"], x["signs"])]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("source"), b.column("lang"), pa.array(cut, pa.bool_()), b.column("signs")],
                names=["doc_id", "source", "lang", "is_cut", "signs"],
            )

    return asked.mapInArrow(run, "doc_id long, source string, lang string, is_cut boolean, signs boolean")


def found(docs: DataFrame) -> DataFrame:
    """(doc_id): the documents whose text was cut."""
    return judged(docs).where("is_cut").select("doc_id").distinct()


def shares(docs: DataFrame) -> DataFrame:
    """(source, texts, cut_texts, cut_share), one row a source."""
    return judged(docs).groupBy("source").agg(
        F.count("*").alias("texts"), F.count_if("is_cut").alias("cut_texts"), F.avg(F.col("is_cut").cast("double")).alias("cut_share")
    )
