"""Problem 3: near-duplicate texts by SuperMinHash, banding, exact verification and union-find.

A text's set is its distinct runs of ``SHINGLE`` words (words: maximal runs of letters and digits, lower-cased).
SuperMinHash (Ertl, 2017) gives every element ranks that are correlated by a permutation: in its j-th step an element
offers j plus a fraction to the j-th place of its own permutation of the signature. Signatures of m places need far
fewer than m steps an element, because a text is finished as soon as every place has an offer from an earlier step;
here whole batches take step j at once and finished texts drop out.

Plan: one Python pass makes (doc_id, 128-bit set key, band keys), which is checkpointed. Texts with the same set form a
class, of which one row represents the others. Band keys of the representatives are counted; keys of two or three rows
give their pairs by arithmetic, only the rare keys of more rows are joined with themselves. The sets of the candidates,
and of no other rows, are then made again from their texts and compared exactly. Links hold between
representatives; members are attached by an equi-join.

The texts of crowded band keys (more than ``CROWD`` representatives) are not paired by the key, as what they share may be
boilerplate. They meet by an exact prefix filter instead (Chaudhuri et al. 2006, Xiao et al. 2008): with all shingles in one
order, the rarest among these texts first, two sets of the wanted similarity share one of the first few shingles of each, and
the places of the first shared one bound their intersection. Boilerplate comes last in the order, so it brings no texts together
that differ too much elsewhere, and no pair is lost.

With 64 bands of 4 places a pair of similarity 0.6 is missed with probability 0.00014, one of 0.65 with 0.000003.

Defined results: null titles and texts count as empty; texts under ``MIN_WORDS`` words have no partners, and in the groups of
all rows (``short_groups``) only those of the same word sequence; exact copies are partners of each other; empty tables give no rows; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscle.operators.components import components
from corpuscle.session import cut

SHINGLE, MIN_WORDS, BANDS, ROWS = 3, 40, 64, 4
#: From so many rows of a key on, the n (n - 1) / 2 pairs of a key cost more than the prefixes of its texts (some 200 rows each, for
#: all of a text's keys together). Any number gives the same pairs.
CROWD = 300
#: Keys that are broadcast at most (8 bytes each); beyond that their rows are found by a shuffled join.
BROADCAST_KEYS = 200_000
#: The most frequent shingles of crowded texts that are put last by their frequency (16 bytes each); all others, at least as
#: rare, keep the order of their hashes. Any number gives the same pairs.
FREQUENT = 500_000
PLACES = BANDS * ROWS
#: Texts of a Python batch are taken together until they have this many shingles.
BATCH = 120_000
_WORD = re.compile(r"[^\W_]+")
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64), in place."""
    x += U(0x9E3779B97F4A7C15)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


class Words(dict):
    """Word to 64-bit hash."""

    def __missing__(self, w: str) -> int:
        import xxhash

        if len(self) > 1_000_000:
            self.clear()
        self[w] = h = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
        return h


def words(title: str | None, text: str | None) -> list[str]:
    return _WORD.findall(f"{title or ''} {text or ''}".lower())


def shingles(ws: list[str], known: Words, width: int = SHINGLE) -> np.ndarray:
    """The distinct hashes of the runs of ``width`` words, sorted."""
    h = np.fromiter(map(known.__getitem__, ws), np.uint64, len(ws))
    n = len(h) - width + 1
    if n < 1:
        return np.empty(0, np.uint64)
    out = h[:n].copy()
    for k in range(1, width):
        mix(out)
        out += h[k : n + k]
    return np.unique(mix(out))


def superminhash(sets: list[np.ndarray], places: int = PLACES) -> np.ndarray:
    """Signatures (len(sets), places) of non-empty sets; equal places estimate the Jaccard similarity."""
    n = len(sets)
    sig = np.full((n, places), _EMPTY, np.uint64)
    if not n:
        return sig
    el = np.concatenate(sets)
    doc = np.repeat(np.arange(n), [len(s) for s in sets])
    flat, order = sig.reshape(-1), None
    with np.errstate(over="ignore"):
        for j in range(places):
            g = mix(el + U(j * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF))
            at = (g % U(places - j)).astype(np.int64) + j
            rows = np.arange(len(el))
            place = at
            if j:
                place = order[rows, at]
                order[rows, at] = order[:, j]
            offer = (U(j) << U(48)) | (mix(g) >> U(16))
            np.minimum.at(flat, doc * places + place, offer)
            open_ = (sig == _EMPTY).any(axis=1)
            if not open_.any():
                break
            live = open_[doc]
            if not live.all():
                el, doc = el[live], doc[live]
                order = order[live] if j else None
            if not j:
                # permutations are held only for the texts that the first step left open, which are never large ones
                order = np.tile(np.arange(places, dtype=np.uint8 if places <= 256 else np.uint16), (len(el), 1))
                order[np.arange(len(el)), at[live]] = 0
    return sig


def band_keys(sig: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One signed 64-bit key for each band of a signature; the band's number is part of it."""
    with np.errstate(over="ignore"):
        key = np.broadcast_to(np.arange(bands, dtype=np.uint64) * U(0xD6E8FEB86659FD93), (len(sig), bands)).copy()
        parts = sig.reshape(len(sig), bands, rows)
        for r in range(rows):
            mix(key)
            key += parts[:, :, r]
        return mix(key).view(np.int64)


def _grouped(batch: pa.RecordBatch, known: Words, min_words: int, width: int) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    rows, sets, total = [], [], 0
    for i, (title, text) in enumerate(zip(batch.column("title"), batch.column("main_text"))):
        ws = words(title.as_py(), text.as_py())
        if len(ws) < max(min_words, width):
            continue
        rows.append(i)
        sets.append(s := shingles(ws, known, width))
        total += len(s)
        if total >= BATCH:
            yield rows, sets
            rows, sets, total = [], [], 0
    if rows:
        yield rows, sets


def _texts(docs: DataFrame, title_col: str, text_col: str, key: str) -> DataFrame:
    return docs.select(
        F.col(key).cast("long").alias("doc_id"), F.col(title_col).alias("title"), F.col(text_col).alias("main_text")
    )


def signatures(
    docs: DataFrame, title_col: str = "title", text_col: str = "main_text", key: str = "doc_id",
    min_words: int = MIN_WORDS, width: int = SHINGLE, bands: int = BANDS, rows: int = ROWS,
) -> DataFrame:
    """(doc_id, set_a, set_b, bands): set key and band keys. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words()
        for b in batches:
            ids = b.column("doc_id")
            for at, sets in _grouped(b, known, min_words, width):
                sig = superminhash(sets, bands * rows)
                with np.errstate(over="ignore"):
                    a = [int(mix(s ^ U(0x243F6A8885A308D3)).sum().view(np.int64)) for s in sets]
                    c = [int(mix(s ^ U(0x13198A2E03707344)).sum().view(np.int64)) for s in sets]
                keys = band_keys(sig, bands, rows)
                ends = pa.array(np.arange(0, keys.size + 1, keys.shape[1], dtype=np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(pa.array(at)), pa.array(a, pa.int64()), pa.array(c, pa.int64()),
                        pa.ListArray.from_arrays(ends, pa.array(keys.reshape(-1))),
                    ],
                    names=["doc_id", "set_a", "set_b", "bands"],
                )

    return _texts(docs, title_col, text_col, key).mapInArrow(
        run, "doc_id long, set_a long, set_b long, bands array<long>"
    )


def shingle_sets(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """(doc_id, shingles) of texts named doc_id, title and main_text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words()
        for b in batches:
            for at, sets in _grouped(b, known, 0, width):
                ends = np.cumsum([0, *map(len, sets)], dtype=np.int32)
                col = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets).view(np.int64)))
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(at)), col], names=["doc_id", "shingles"])

    return docs.mapInArrow(run, "doc_id long, shingles array<long>")


def _pairs(members: DataFrame, on: list[str]) -> DataFrame:
    other = members.select(*on, F.col("rep").alias("rep_b"))
    return members.join(other, on).where("rep < rep_b").select(F.col("rep").alias("a"), F.col("rep_b").alias("b"))


def frequent_shingles(texts: DataFrame, width: int = SHINGLE, most: int = FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` most frequent shingles of some texts, sorted, and the number of texts that have them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words()
        for b in batches:
            for _, sets in _grouped(b, known, 0, width):
                s, n = np.unique(np.concatenate(sets), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(s.view(np.int64)), pa.array(n)], names=["s", "n"])

    counted = texts.mapInArrow(run, "s long, n long").groupBy("s").agg(F.sum("n").alias("n")).where("n > 3")
    top = counted.orderBy(F.desc("n"), "s").limit(most).toArrow()
    s = top.column("s").to_numpy().view(np.uint64)
    order = np.argsort(s)
    return s[order], top.column("n").to_numpy()[order]


def prefixes(texts: DataFrame, threshold: float, frequent: tuple[np.ndarray, np.ndarray], width: int = SHINGLE) -> DataFrame:
    """(rep, size, at, s, indexed): the first shingles of each text in the order of :func:`frequent_shingles`.

    A set of n shingles that is similar to a set of at most n shares one of its first n - ceil(t n) + 1 with it; the
    first n - ceil(2 t n / (1 + t)) + 1 (``indexed``) are enough on the side of the smaller set.
    """
    t, sent = round(threshold * 10_000), texts.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, (often, n_often) = Words(), sent.value
        for b in batches:
            ids = b.column("doc_id").to_numpy()
            for at, sets in _grouped(b, known, 0, width):
                rep, size, place, kept, indexed = [], [], [], [], []
                for i, s in zip(at, sets):
                    n = len(s)
                    k = np.minimum(np.searchsorted(often, s), max(0, len(often) - 1))
                    df = np.where(often[k] == s, n_often[k], 0) if len(often) else np.zeros(n, np.int64)
                    probe, index = n + (-t * n // 10_000) + 1, n + (-2 * t * n // (10_000 + t)) + 1
                    kept.append(s[np.argsort(df, kind="stable")[:probe]])
                    place.append(np.arange(probe))
                    indexed.append(np.arange(probe) < index)
                    rep.append(np.full(probe, ids[i]))
                    size.append(np.full(probe, n))
                columns = [np.concatenate(x) for x in (rep, size, place, kept, indexed)]
                columns[3] = columns[3].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["rep", "size", "at", "s", "indexed"])

    return texts.mapInArrow(run, "rep long, size long, at long, s long, indexed boolean")


def prefix_pairs(texts: DataFrame, threshold: float, width: int = SHINGLE) -> DataFrame:
    """(a, b), a < b, with repetitions: at least all pairs of texts (doc_id, title, main_text) that are similar."""
    t = round(threshold * 10_000)
    p = prefixes(texts, threshold, frequent_shingles(texts, width), width)
    x = p.select("s", F.col("rep").alias("x"), F.col("size").alias("m"), F.col("at").alias("i"))
    y = p.where("indexed").select("s", F.col("rep").alias("y"), F.col("size").alias("n"), F.col("at").alias("j"))
    fits = (F.col("n") <= F.col("m")) & (F.col("n") * 10_000 >= F.col("m") * t) & (F.col("x") != F.col("y"))
    most = F.least(F.col("m") - F.col("i"), F.col("n") - F.col("j"))  # of the intersection, if this is the first in common
    met = x.join(y, "s").where(fits & (most * (10_000 + t) >= t * (F.col("m") + F.col("n"))))
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def candidates(reps: DataFrame, texts: DataFrame, threshold: float = 0.6, width: int = SHINGLE) -> DataFrame:
    """Distinct pairs (a, b), a < b, of representatives that share a band key, or of crowded keys at least the similar ones.

    One shuffle of (key, id) counts the keys. From its least and greatest id and the exclusive or of all ids follow the
    pairs of keys of two and three rows; only rows of more crowded keys are looked up again.
    """
    keyed = reps.select("rep", F.explode("bands").alias("k"))
    counted = keyed.groupBy("k").agg(
        F.count("*").alias("n"), F.min("rep").alias("a"), F.max("rep").alias("b"), F.bit_xor("rep").alias("x")
    )
    shared = cut(counted.where("n > 1"))
    third = F.col("x").bitwiseXOR(F.col("a")).bitwiseXOR(F.col("b"))
    pair = lambda a, b: F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    a, b = F.col("a"), F.col("b")
    few = F.when(F.col("n") == 2, F.array(pair(a, b))).otherwise(F.array(pair(a, b), pair(a, third), pair(third, b)))
    out = shared.where("n <= 3").select(F.explode(few).alias("p")).select("p.a", "p.b")
    sizes = shared.where("n > 3").agg(F.count("*"), F.count_if(F.col("n") > CROWD)).first()

    def rows_of(keys: DataFrame, n: int) -> DataFrame:
        keys = keys.select("k")
        return keyed.join(F.broadcast(keys) if n <= BROADCAST_KEYS else keys, "k", "left_semi")

    if sizes[0] > sizes[1]:
        out = out.union(_pairs(rows_of(shared.where(F.col("n").between(4, CROWD)), sizes[0] - sizes[1]), ["k"]))
    if sizes[1]:
        crowded = cut(rows_of(shared.where(F.col("n") > CROWD), sizes[1]).select(F.col("rep").alias("doc_id")).distinct())
        out = out.union(prefix_pairs(texts.join(crowded, "doc_id", "left_semi"), threshold, width))
    return out.distinct()


def similar(common: Column, size_a: Column, size_b: Column, threshold: float) -> Column:
    """intersection >= threshold * union, in whole numbers for thresholds of up to four decimals."""
    t = round(threshold * 10_000)
    return common * (10_000 + t) >= t * (size_a + size_b)


def short_texts(
    docs: DataFrame, title_col: str = "title", text_col: str = "main_text", key: str = "doc_id", min_words: int = MIN_WORDS, width: int = SHINGLE,
) -> DataFrame:
    """(doc_id, a, b): texts of fewer words than have signatures, with a hash of their word sequence, null without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        least = max(min_words, width)
        for batch in batches:
            at, a, b = [], [], []
            for i, (title, text) in enumerate(zip(batch.column("title"), batch.column("main_text"))):
                found = _WORD.finditer(f"{title.as_py() or ''} {text.as_py() or ''}".lower())
                ws = [m.group() for m in islice(found, least)]
                if len(ws) < least:
                    d = xxhash.xxh3_128_digest(" ".join(ws).encode("utf-8", "surrogatepass"))
                    at.append(i)
                    a.append(int.from_bytes(d[:8], "big", signed=True) if ws else None)
                    b.append(int.from_bytes(d[8:], "big", signed=True) if ws else None)
            ids = batch.column("doc_id").take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["doc_id", "a", "b"])

    return _texts(docs, title_col, text_col, key).mapInArrow(run, "doc_id long, a long, b long")


def short_groups(docs: DataFrame, **columns) -> DataFrame:
    """(doc_id, class_id, group_id, links) of :func:`short_texts`: equal word sequences are a class and a group.

    A text without words is a class of its own.
    """
    short = cut(short_texts(docs, **columns))
    first = short.where("a is not null").groupBy("a", "b").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    rep = F.coalesce("rep", "doc_id")
    return short.join(first, ["a", "b"], "left").select(
        "doc_id", rep.alias("class_id"), rep.alias("group_id"), (F.coalesce("copies", F.lit(1)) - 1).alias("links")
    )


class NearDuplicates:
    """The stages of one run; ``classes`` and ``links`` are checkpointed tables."""

    def __init__(
        self, docs: DataFrame, threshold: float = 0.6, title_col: str = "title", text_col: str = "main_text",
        key: str = "doc_id", min_words: int = MIN_WORDS, width: int = SHINGLE,
    ):
        texts = _texts(docs, title_col, text_col, key)
        sigs = cut(signatures(docs, title_col, text_col, key, min_words, width))
        first = sigs.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
        #: (doc_id, rep): rep is the least id with the same set.
        self.classes = sigs.select("doc_id", "set_a", "set_b").join(first, ["set_a", "set_b"]).select("doc_id", "rep", "copies")
        reps = sigs.join(first.select("rep"), sigs.doc_id == first.rep, "left_semi").withColumnRenamed("doc_id", "rep")
        found = cut(candidates(reps, texts, threshold, width))
        wanted = found.select(F.col("a").alias("doc_id")).union(found.select("b")).distinct()
        sets = shingle_sets(texts.join(wanted, "doc_id", "left_semi"), width)
        a = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("set_a"))
        b = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("set_b"))
        common = F.size(F.array_intersect("set_a", "set_b"))
        #: (a, b): pairs of representatives of different sets, a < b, that are similar.
        self.links = (
            found.join(a, "a").join(b, "b").where(similar(common, F.size("set_a"), F.size("set_b"), threshold)).select("a", "b")
        )

    def pairs(self) -> DataFrame:
        """(doc_id_a, doc_id_b), a < b: every pair of similar rows, copies included."""
        m = self.classes
        x = m.select(F.col("doc_id").alias("x"), F.col("rep").alias("a"))
        y = m.select(F.col("doc_id").alias("y"), F.col("rep").alias("b"))
        across = self.links.join(x, "a").join(y, "b").select("x", "y")
        some = m.where("copies > 1")
        within = some.select(F.col("doc_id").alias("x"), "rep").join(some.select(F.col("doc_id").alias("y"), "rep"), "rep")
        within = within.where("x < y").select("x", "y")
        return across.union(within).select(F.least("x", "y").alias("doc_id_a"), F.greatest("x", "y").alias("doc_id_b"))

    def groups(self) -> DataFrame:
        """(doc_id, class_id, group_id, links): one row for each text with at least ``min_words`` words.

        class_id: least id with the same set; group_id: least id of the connected component; links: number of other
        rows the text is similar to.
        """
        links = cut(self.links)
        size = self.classes.groupBy("rep").agg(F.max("copies").alias("copies"))
        ends = links.select(F.col("a").alias("rep"), F.col("b").alias("other")).union(links.select("b", "a"))
        far = ends.join(size.withColumnRenamed("rep", "other"), "other").groupBy("rep").agg(F.sum("copies").alias("far"))
        comp = components(links, "a", "b").withColumnRenamed("node", "rep")
        out = self.classes.join(far, "rep", "left").join(comp, "rep", "left")
        return out.select(
            "doc_id", F.col("rep").alias("class_id"), F.coalesce("component", "rep").alias("group_id"),
            (F.coalesce("far", F.lit(0)) + F.col("copies") - 1).alias("links"),
        )
