"""Top-k search of a stated query set against all documents, in blocks.

The query set is cut into blocks by a hash of the query id, so that no block has more than ``ENTRIES`` numbers or
``BYTES`` of terms; only one block at a time is gathered, checked and sent to the workers as one matrix. Each task scores
its documents in Arrow batches and keeps only its own k best for every query, so what is shuffled is queries x tasks x k
rows, never queries x documents. Scores are rounded before they are ranked and ties go to the smaller document id, so the
result does not depend on partitioning.

Sparse vectors: the corpus is tokenised once into a token table (:func:`term_index`), from which frequencies, queries and
scores are all made. Its terms are encoded by batch, so weighting and scoring are array operations over the whole batch.
Queries and texts are put into groups of alike ones; terms that a pair of groups often shares are scored by a matrix product
in single precision, the others by their postings. Only pairs that may be among the k best within the bound of its error are
scored again in double precision, so no pair is left out and the ranking is that of the exact scores. An evaluation asks for judged
documents only; :func:`unsettled` finds the queries that can have one among their k best, and only those are searched. A join of the postings of both sides in the JVM would write a row for every term that
a query and a document have in common (351 million rows at sf0.1, where both sides are whole texts) to add them up again.

Documents that share nothing with a query have score 0 and take part in the ranking. Null or empty texts and vectors
score 0 as well; an empty query set or corpus gives no rows; repeated ids are ranked as separate rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpuscle.session import cut, spread

#: Most entries (query, term) or numbers of one block, and most bytes of its terms; a block is gathered and broadcast.
ENTRIES, BYTES = 4_000_000, 64_000_000
#: Terms that one in so many queries of a group has may be scored by a matrix product; it is cheaper than the postings for a
#: term that at least one in so many pairs of a text and a query shares. Groups of alike queries of a block.
COMMON, DENSE, GROUPS = 64, 500, 8
#: Most queries of a group and most terms of its matrix.
MEMBERS, WIDTH = 8192, 2000
#: Most texts that queries are settled against; a term that one in so many of them has is scored by a matrix product. Pairs that
#: are settled at once, and texts after which a batch is left as it is if most of its pairs stay.
FIRST, SHARED, PAIRS, TRIED = 20_000, 200, 4096, 2048
SCHEMA = "query_id long, doc_id long, score double"


class Best:
    """The k best documents of every query so far."""

    def __init__(self, queries: np.ndarray, k: int):
        self.queries, self.k = queries, k
        self.score = np.empty((len(queries), 0))
        self.doc = np.empty((len(queries), 0), np.int64)

    def offer(self, docs: np.ndarray, scores: np.ndarray) -> None:
        """``scores``: documents x queries. Only scores that may be among the k best, ties included, are sorted."""
        new, (nq, held), n = scores.T, self.score.shape, len(docs)
        if held == self.k:
            # rounding moves a score by less than this, so most are told apart without it
            keep = new >= self.score[:, -1:] - 1e-9
        elif n > self.k:
            keep = new >= np.partition(new, n - self.k, axis=1)[:, n - self.k, None] - 1e-9
        else:
            keep = np.ones(new.shape, bool)
        at, which = np.nonzero(keep)
        q = np.concatenate([np.repeat(np.arange(nq), held), at])
        score = np.concatenate([self.score.reshape(-1), np.round(new[at, which], 9) + 0.0])
        doc = np.concatenate([self.doc.reshape(-1), docs[which]])
        order = np.lexsort((doc, -score, q))
        starts = np.searchsorted(q[order], np.arange(nq))
        first = order[(np.arange(len(order)) - starts[q[order]]) < self.k]
        self.score, self.doc = score[first].reshape(nq, -1), doc[first].reshape(nq, -1)

    def floor(self, queries: np.ndarray) -> np.ndarray:
        """Lower bounds of the k best scores of some queries so far, in descending order."""
        out = np.full((len(queries), self.k), -np.inf)
        out[:, : self.score.shape[1]] = self.score[queries] - 1e-9
        return out

    def take(self, q: np.ndarray, docs: np.ndarray, scores: np.ndarray) -> None:
        """Rank single pairs of a query's place, a document and their score."""
        of, at = np.unique(q, return_inverse=True)
        held = self.score.shape[1]
        if held < self.k:
            more = self.k - held
            self.score = np.hstack([self.score, np.full((len(self.queries), more), -np.inf)])
            self.doc = np.hstack([self.doc, np.zeros((len(self.queries), more), np.int64)])
        one = np.concatenate([np.repeat(np.arange(len(of)), self.k), at])
        score = np.concatenate([self.score[of].reshape(-1), np.round(scores, 9) + 0.0])
        doc = np.concatenate([self.doc[of].reshape(-1), docs])
        order = np.lexsort((doc, -score, one))
        starts = np.searchsorted(one[order], np.arange(len(of)))
        first = order[(np.arange(len(order)) - starts[one[order]]) < self.k]
        self.score[of], self.doc[of] = score[first].reshape(-1, self.k), doc[first].reshape(-1, self.k)

    def batch(self, asked: np.ndarray | None = None) -> pa.RecordBatch:
        """All rows, or those of the queries that are ``asked``."""
        n = self.doc.shape[1]
        taken = ~np.isneginf(self.score)  # places that a document took
        if asked is not None:
            taken &= asked[:, None]
        if not taken.all():
            return pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(self.queries, taken.sum(1))), pa.array(self.doc[taken]), pa.array(self.score[taken])],
                names=["query_id", "doc_id", "score"],
            )
        return pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(self.queries, n)), pa.array(self.doc.reshape(-1)), pa.array(self.score.reshape(-1))],
            names=["query_id", "doc_id", "score"],
        )


def ranked(scored: DataFrame, k: int) -> DataFrame:
    """(query_id, doc_id, score, rank) of the k best, ties to the smaller id."""
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return scored.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def without_self(ranking: DataFrame) -> DataFrame:
    """The ranking without the query's own document; ranks close up."""
    w = W.partitionBy("query_id").orderBy("rank")
    return ranking.where("doc_id <> query_id").withColumn("rank", F.row_number().over(w).cast("long"))


def _empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def blocks(rows: DataFrame, key: str, numbers: int, size: int) -> Iterator[pa.Table]:
    """The checkpointed ``rows`` in blocks of whole keys, each gathered by itself; ``numbers`` and ``size`` tell how many."""
    n = max(1, -(-numbers // ENTRIES), -(-size // BYTES))
    for i in range(n):
        one = rows if n == 1 else rows.where(F.pmod(F.xxhash64(key), F.lit(n)) == i)
        yield one.toArrow()


def lexical_weights(tf: np.ndarray, row: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The lexical encoder: 1 + ln(tf), scaled to length 1. A row of the arrays is a term of a text."""
    w = 1.0 + np.log(tf)
    return w / np.sqrt(np.bincount(row, w * w, len(lengths)))[row]


def bm25_weights(avgdl: float, k1: float = 1.5, b: float = 0.75) -> Callable:
    """The document side of BM25: saturated term frequencies; the inverse document frequency is on the query's side."""

    def weights(tf: np.ndarray, row: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        return tf * (k1 + 1) / (tf + (k1 * (1 - b + b * lengths / avgdl))[row])

    return weights


class Index:
    """The queries of a block in groups of alike ones; of each group the terms with their postings."""

    def __init__(self, table: pa.Table):
        """``table``: query_id, term and one or more columns of weights, of which :meth:`offer` takes a sum."""
        query = table.column("query_id").to_numpy()
        self.queries, q = np.unique(query, return_inverse=True)
        terms = table.column("term").combine_chunks().dictionary_encode()
        self.terms, term, w = terms.dictionary, terms.indices.to_numpy().astype(np.int64), np.stack([c.to_numpy() for c in table.columns[2:]])
        # directions that tell groups apart come from the common terms
        often = np.flatnonzero(np.bincount(term, minlength=len(self.terms)) * COMMON >= len(self.queries))
        self.place = np.full(len(self.terms), -1)
        self.place[often] = np.arange(len(often))
        dense = self.place[term] >= 0
        group = self._grouped(q[dense], self.place[term[dense]], w[:, dense].sum(0))
        self.groups = []
        for g in range(len(self.centres)):
            every = np.flatnonzero(group == g)
            for part in np.array_split(every, -(-len(every) // MEMBERS)) if len(every) else ():
                inside = np.full(len(self.queries), -1, np.int32)
                inside[part] = np.arange(len(part))
                at = np.flatnonzero(inside[q] >= 0)
                at = at[np.lexsort((q[at], term[at]))]
                known, starts = np.unique(term[at], return_index=True)
                self.groups.append((g, part, known.astype(np.int32), np.append(starts, len(at)), inside[q[at]], w[:, at]))

    def _grouped(self, q: np.ndarray, place: np.ndarray, w: np.ndarray) -> np.ndarray:
        """The group of each query, by a few rounds of k-means from some of them; sets ``centres``. Any grouping gives the same results."""
        nq, n = len(self.queries), int(self.place.max(initial=-1)) + 1
        length = np.sqrt(np.bincount(q, w * w, nq))
        length[length == 0] = 1

        def rows(lo: int, hi: int) -> np.ndarray:
            out, some = np.zeros((hi - lo, n), np.float32), (q >= lo) & (q < hi)
            out[q[some] - lo, place[some]] = w[some] / length[q[some]]
            return out

        some = rows(0, min(nq, 2000))
        count = GROUPS if nq >= 64 * GROUPS and n else 1
        self.centres = some[np.linspace(0, len(some) - 1, count).astype(int)]
        for _ in range(6 * (count > 1)):
            near = self.nearest(some)
            self.centres = np.stack([some[near == g].mean(0) if (near == g).any() else self.centres[g] for g in range(count)])
            self.centres /= np.maximum(np.sqrt((self.centres**2).sum(1)), 1e-9)[:, None]
        return np.concatenate([self.nearest(rows(lo, min(nq, lo + 2000))) for lo in range(0, nq, 2000)])

    def nearest(self, rows: np.ndarray) -> np.ndarray:
        return (rows @ self.centres.T).argmax(1) if len(self.centres) > 1 else np.zeros(len(rows), np.int64)

    def offer(self, best: Best, ids: np.ndarray, row: np.ndarray, term: np.ndarray, value: np.ndarray, shares: np.ndarray | None = None) -> None:
        """Rank texts, given by their (row, term, value) with terms of this index, among the best of all queries.

        With ``shares`` a query's vector is the sum of its columns of weights with these shares, scaled to length 1.

        Texts are taken by groups too. A text and a query of groups that share a term often meet there in a matrix product, else by
        the postings; both in single precision, whose error is bounded. Pairs that may be among the k best within that bound are
        scored again in double precision, so the ranking is that of the exact scores.
        """
        n = len(ids)
        some = self.place[term] >= 0
        rows = np.zeros((n, self.centres.shape[1]), np.float32)
        rows[row[some], self.place[term[some]]] = value[some]
        near = self.nearest(rows)
        by = np.argsort(near, kind="stable")
        back = np.empty(n, np.int64)
        back[by] = np.arange(n)
        near, ids, row = near[by], ids[by], back[row]
        order = np.argsort(row, kind="stable")
        row, term, value = row[order], term[order], value[order]
        for own, members, known, starts, postings, parts in self.groups:
            w = parts[0]
            if shares is not None:
                w = shares @ parts
                length = np.sqrt(np.bincount(postings, w * w, len(members)))
                w = w / np.where(length > 0, length, 1.0)[postings]
            _offer(best, (own, members, known, starts, postings, w), len(self.terms), near, ids, row, term, value)

    def asked(self, shares: np.ndarray) -> np.ndarray:
        """Whether each query has a vector with these shares."""
        out = np.zeros(len(self.queries), bool)
        for _, members, _, _, postings, parts in self.groups:
            out[members] = np.bincount(postings, np.abs(shares @ parts), len(members)) > 0
        return out


def _expanded(begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers begin .. begin + n - 1 of all, one after the other."""
    return np.arange(n.sum()) + np.repeat(begin - np.cumsum(n) + n, n)


def _offer(best: Best, group: tuple, vocabulary: int, near: np.ndarray, ids: np.ndarray, row: np.ndarray, term: np.ndarray, value: np.ndarray) -> None:
    """Rank texts, ordered by their groups ``near``, among the best of the queries of one group."""
    own, members, known, starts, postings, w = group
    nq, n, k, count = len(members), len(ids), best.k, np.diff(starts)
    lut = np.full(vocabulary, -1, np.int32)
    lut[known] = np.arange(len(known))
    term = lut[term]
    row, term, value = row[term >= 0], term[term >= 0], value[term >= 0]
    ends = np.searchsorted(row, np.arange(n + 1))
    # dense sides of the terms that many queries of the group have
    common = np.flatnonzero(count * COMMON >= nq)
    common = np.sort(common[np.argsort(-count[common], kind="stable")[:WIDTH]])
    place = np.full(len(known), -1, np.int32)
    place[common] = np.arange(len(common))
    here = np.repeat(place, count)
    exact = np.zeros((nq, len(common)))
    exact[postings[here >= 0], here[here >= 0]] = w[here >= 0]
    single, share, w32 = np.ascontiguousarray(exact.T, np.float32), count[common] / nq, w.astype(np.float32)
    side = np.zeros((n, len(common)), np.float32)
    some = place[term] >= 0
    side[row[some], place[term[some]]] = value[some]
    # a sum of m products in single precision is wrong by (m + 3) units of its lengths' product at most
    unit = (int(np.diff(ends).max(initial=0)) + 8) * 2.0**-23
    wide = np.sqrt(np.bincount(row, value * value, n).max(initial=0.0)) if n else 0.0
    error = unit * wide * np.sqrt(np.bincount(postings, w * w, nq)) + 1e-9
    floor = best.floor(members)
    # without negative numbers all scores are 0 at least, and of texts that share nothing with a query the smallest ids count
    apart = n >= k and (w >= 0).all() and (value >= 0).all()
    if apart:
        floor = np.maximum(floor, 0.0)
    found: list[tuple[np.ndarray, ...]] = []
    starts_of = np.searchsorted(near, np.arange(int(near.max(initial=0)) + 2))
    spans = [(g, int(a), int(b)) for g, (a, b) in enumerate(zip(starts_of[:-1], starts_of[1:])) if a < b]
    step, most = (64 if (floor[:, -1] <= 0).any() else 1 << 20), max(32, min(1024, 2_000_000 // nq))
    for g, begin, end in sorted(spans, key=lambda x: (x[0] != own, x[0])):
        dims = np.flatnonzero((side[begin:end] != 0).mean(0) * share * DENSE > 1)
        dense = np.zeros(len(known), bool)
        dense[common[dims]] = True
        right = single[dims]
        lo = begin
        while lo < end:
            hi = min(end, lo + min(step, most))
            step = min(2 * step, 1 << 20)
            scores = side[lo:hi, dims] @ right
            e = slice(ends[lo], ends[hi])
            t, r, v = term[e], row[e] - lo, value[e]
            t, r, v = (x[~dense[t]] for x in (t, r, v))
            m = count[t]
            at = _expanded(starts[t], m)
            if len(at):
                np.add.at(scores.reshape(-1), np.repeat(r * nq, m) + postings[at], np.repeat(v.astype(np.float32), m) * w32[at])
            bound = floor[:, -1] - error
            if (floor[:, -1] <= 0).mean() > 0.1 and hi - lo >= k:
                bound = np.maximum(bound, np.partition(scores, hi - lo - k, axis=0)[hi - lo - k] - 2 * error)
            limit = np.nextafter(bound.astype(np.float32), np.float32(-np.inf))
            if apart:
                limit = np.maximum(limit, np.finfo(np.float32).tiny)
            d, q = np.divmod(np.flatnonzero(scores >= limit), nq)
            if len(d):
                s = scores[d, q].astype(np.float64)
                found.append((d + lo, q, s))
                _raise(floor, q, s - error[q], k)
            lo = hi
    d, q, s = (np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, np.int64),) * 3
    still = s + error[q] >= floor[q, -1]
    d, q = d[still], q[still]
    if apart and len(few := np.flatnonzero(floor[:, -1] <= 0)):
        first = np.argpartition(ids, k - 1)[:k]
        every = np.unique(np.concatenate([d * nq + q, (first[:, None] * nq + few).reshape(-1)]))
        d, q = np.divmod(every, nq)
    order = np.argsort(q, kind="stable")
    d, q = d[order], q[order]
    key = np.repeat(np.arange(len(known), dtype=np.int64) * nq, count) + postings
    for lo in range(0, len(d), 20_000):
        dd, qq = d[lo : lo + 20_000], q[lo : lo + 20_000]
        m = ends[dd + 1] - ends[dd]
        at, pair = _expanded(ends[dd], m), np.repeat(np.arange(len(dd)), m)
        t, qr = term[at], qq[pair]
        often = place[t] >= 0
        weight = np.zeros(len(at))
        weight[often] = exact[qr[often], place[t[often]]]
        asked = t[~often].astype(np.int64) * nq + qr[~often]
        where = np.minimum(np.searchsorted(key, asked), len(key) - 1)
        weight[~often] = np.where(key[where] == asked, w[where], 0.0)
        best.take(members[qq], ids[dd], np.bincount(pair, weight * value[at], len(dd)))


def _raise(floor: np.ndarray, q: np.ndarray, s: np.ndarray, k: int) -> None:
    """Put lower bounds ``s`` of scores of queries ``q`` among their k largest, in descending order."""
    order = np.lexsort((-s, q))
    q, s = q[order], s[order]
    of, first, n = np.unique(q, return_index=True, return_counts=True)
    place = np.arange(len(q)) - np.repeat(first, n)
    new = np.full((len(of), k), -np.inf)
    some = place < k
    new[np.repeat(np.arange(len(of)), n)[some], place[some]] = s[some]
    floor[of] = -np.sort(-np.concatenate([floor[of], new], axis=1), axis=1)[:, :k]


def term_index(docs: DataFrame, fields: list[str]) -> DataFrame:
    """(doc_id, and for each field its terms, their tf and their number): the token table of a corpus, one Arrow pass.

    Terms are the lower-case tokens between white space, each once. Texts of few files are spread evenly first; where
    there are as many files as cores, nothing is shuffled.
    """
    kinds = ", ".join(f"`{f}` array<string>, `{f}_tf` array<int>, `{f}_len` long" for f in fields)
    rows = docs.select("doc_id", *fields)
    if len(rows.inputFiles()) < rows.sparkSession.sparkContext.defaultParallelism:
        rows = rows.repartition(spread(rows), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = {"doc_id": b.column(0)}
            for k, f in enumerate(fields, 1):
                counted = [Counter((t.as_py() or "").lower().split()) for t in b.column(k)]
                ends = np.cumsum([0, *map(len, counted)], dtype=np.int32)
                tf = np.fromiter((n for c in counted for n in c.values()), np.int32, ends[-1])
                out[f] = pa.ListArray.from_arrays(ends, pa.array([t for c in counted for t in c], pa.string()))
                out[f"{f}_tf"] = pa.ListArray.from_arrays(ends, pa.array(tf))
                out[f"{f}_len"] = pa.array([c.total() for c in counted], pa.int64())
            yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

    return rows.mapInArrow(run, f"doc_id long, {kinds}")


def text_parts(batch: pa.RecordBatch, fields: int, weights: Callable) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """(row, code, values of each field, dictionary) of a batch of a token table: the terms of every text."""
    n = batch.num_rows
    flat = pa.chunked_array([batch.column(3 * f + 1).flatten() for f in range(fields)]).combine_chunks().dictionary_encode()
    codes, size = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64), max(1, len(flat.dictionary))
    keys, values, at = [], [], 0
    for f in range(fields):
        row = np.repeat(np.arange(n), pc.list_value_length(batch.column(3 * f + 1)).to_numpy())
        tf = batch.column(3 * f + 2).flatten().to_numpy().astype(float)
        keys.append(row * size + codes[at : at + len(row)])
        at += len(row)
        values.append(weights(tf, row, batch.column(3 * f + 3).to_numpy().astype(float)))
    if fields == 1:
        return row, codes, values[0][None], flat.dictionary
    key, back = np.unique(np.concatenate(keys), return_inverse=True)
    parts, at = np.zeros((fields, len(key))), 0
    for f, v in enumerate(values):
        parts[f, back[at : at + len(v)]] = v
        at += len(v)
    return key // size, key % size, parts, flat.dictionary


def summed(row: np.ndarray, parts: np.ndarray, shares: np.ndarray, unit: bool, n: int) -> np.ndarray:
    """Fields added with their shares, and with ``unit`` scaled to length 1 for each of ``n`` texts."""
    value = shares @ parts
    if unit:
        length = np.sqrt(np.bincount(row, value * value, n))
        value = value / np.where(length > 0, length, 1.0)[row]
    return value


def sparse_search(
    index: DataFrame, entries: DataFrame, k: int, fields: dict[str, float], weights: Callable, unit: bool = False
) -> DataFrame:
    """(query_id, doc_id, score, rank) by sparse dot products.

    ``index``: a token table with ``fields``, whose vectors are added with the fields' weights (and with ``unit`` scaled to
    length 1). ``entries``: (query_id, term, weight) of the queries.
    """
    return ranked(_searched(index, entries.select("query_id", "term", F.col("weight").cast("double").alias("weight")), k, [fields], weights, unit).drop("trial"), k)


def unsettled(
    index: DataFrame, vectors: DataFrame, judged: DataFrame, k: int, text: str, weights: Callable, asked: Callable = lambda w, row, lengths: w
) -> DataFrame:
    """(query_id): the queries that can have a judged document, other than themselves, among their k best.

    ``index``: a token table with ``text``, weighted by ``weights``. ``vectors``: (query_id, q_term, q_value), all terms of a
    query in one row, weighted by ``asked``. ``judged``: pairs (query_id, doc_id). Each pair is scored; it is settled when k texts
    of a part of the corpus score surely higher, as then at least k of the corpus do. The part is sent to the workers: texts by a
    hash, within ``FIRST``, ``ENTRIES`` and ``BYTES`` about. A pair that stays leaves its query to the search of all texts, so no
    result depends on the part.
    """
    columns = [text, f"{text}_tf", f"{text}_len"]
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    n, numbers, size = index.agg(F.count("*"), total(F.size(text)), total(F.octet_length(F.concat_ws("", text)))).first()
    parts = max(1, -(-n // FIRST), -(-numbers // ENTRIES), -(-size // BYTES))
    part = index if parts == 1 else index.where(F.pmod(F.xxhash64("doc_id"), F.lit(parts)) == 0)
    sent = index.sparkSession.sparkContext.broadcast(Part(part.select("doc_id", *columns).toArrow(), weights))
    # the rows are few for their work: adaptive execution must not put them into fewer tasks than there are cores
    pairs = judged.select("query_id", "doc_id").where("query_id <> doc_id").distinct().repartition(spread(judged), "doc_id")
    spaced = vectors.repartition(spread(vectors), "query_id")
    rows = pairs.join(index.select("doc_id", *columns), "doc_id").join(spaced, "query_id").select("query_id", *columns, "q_term", "q_value")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, PAIRS):
                some = b.slice(lo, PAIRS)
                stay = sent.value.stay(some, weights, asked, k)
                yield pa.RecordBatch.from_arrays([some.column(0).take(pa.array(stay))], names=["query_id"])

    return rows.mapInArrow(run, "query_id long").distinct()


class Part:
    """Some texts of a corpus, in an order of chance, with their terms from the most common one."""

    def __init__(self, table: pa.Table, weights: Callable):
        """``table``: a token table of one field."""
        batch = pa.RecordBatch.from_arrays([c.combine_chunks() for c in table.columns], names=table.column_names)
        batch = batch.take(pa.array(np.random.default_rng(0).permutation(batch.num_rows)))
        row, code, (value,), seen = text_parts(batch, 1, weights)
        df = np.bincount(code, minlength=len(seen))
        order = np.argsort(-df, kind="stable")
        self.terms, place = seen.take(pa.array(order)), np.empty(len(seen), np.int64)
        place[order] = np.arange(len(seen))
        self.width = min(WIDTH, int((df * SHARED >= batch.num_rows).sum()))
        by = np.argsort(row, kind="stable")
        self.ends = np.searchsorted(row[by], np.arange(batch.num_rows + 1))
        self.row, self.term, self.value = row[by].astype(np.int32), place[code[by]].astype(np.int32), value[by]
        self.longest = np.sqrt(np.bincount(row, value * value, batch.num_rows).max(initial=0.0))

    def stay(self, pairs: pa.RecordBatch, weights: Callable, asked: Callable, k: int) -> np.ndarray:
        """The pairs of which not k texts are known to score higher. ``pairs``: query_id, the document's terms, tf and number, the query's terms and values."""
        n, length = pairs.num_rows, pc.list_value_length(pairs.column(4)).to_numpy()
        row, code, (value,), seen = text_parts(pairs, 1, weights)
        words, q = pairs.column(4).flatten().dictionary_encode(), np.repeat(np.arange(n), length)
        term, w = words.indices.to_numpy().astype(np.int64), asked(pairs.column(5).flatten().to_numpy().astype(float), q, length)
        # the scores of the pairs themselves
        code = pc.fill_null(pc.index_in(seen, words.dictionary), -1).to_numpy(zero_copy_only=False)[code]
        row, code, value = row[code >= 0], code[code >= 0], value[code >= 0]
        size = max(1, len(words.dictionary))
        by = np.argsort(q * size + term)
        key, wanted = (q * size + term)[by], row * size + code
        at = np.minimum(np.searchsorted(key, wanted), max(0, len(key) - 1))
        score = np.bincount(row, np.where(key[at] == wanted, w[by][at], 0.0) * value, n) if len(key) else np.zeros(n)
        # surely higher: by more than rounding and the order of a sum can make
        limit = np.round(score, 9) + 2e-9 + 1e-11 * self.longest * np.sqrt(np.bincount(q, w * w, n))
        term = pc.fill_null(pc.index_in(words.dictionary, self.terms), -1).to_numpy(zero_copy_only=False).astype(np.int64)[term]
        often = (term >= 0) & (term < self.width)
        common = np.zeros((n, self.width))
        common[q[often], term[often]] = w[often]
        rare = np.flatnonzero(term >= self.width)
        rare = rare[np.argsort(term[rare], kind="stable")]
        q, term, w = q[rare], term[rare], w[rare]
        alive, higher, lo, step = np.arange(n), np.zeros(n, np.int64), 0, 64
        while len(alive) and lo < len(self.ends) - 1:
            hi = min(len(self.ends) - 1, lo + min(step, max(64, 4_000_000 // len(alive))))
            step = min(2 * step, 2048)
            e = slice(self.ends[lo], self.ends[hi])
            r, t, v = self.row[e] - lo, self.term[e], self.value[e]
            dense = t < self.width
            side = np.zeros((hi - lo, self.width))
            side[r[dense], t[dense]] = v[dense]
            scores = common[alive] @ side.T
            place = np.full(n, -1)
            place[alive] = np.arange(len(alive))
            q, term, w = (x[place[q] >= 0] for x in (q, term, w)) if len(q) else (q, term, w)
            count = np.bincount(term, minlength=len(self.terms))
            r, t, v = r[~dense], t[~dense], v[~dense]
            m = count[t]
            at = _expanded((np.cumsum(count) - count)[t], m)
            if len(at):
                np.add.at(scores.reshape(-1), place[q[at]] * (hi - lo) + np.repeat(r, m), np.repeat(v, m) * w[at])
            higher[alive] += (scores > limit[alive, None]).sum(1)
            alive, lo = alive[higher[alive] < k], hi
            if lo >= TRIED and 2 * len(alive) > n:
                break
        return alive


def sparse_trials(index: DataFrame, entries: DataFrame, k: int, grid: list[dict[str, float]], weights: Callable) -> DataFrame:
    """(trial, query_id, doc_id, score, rank) for several sets of fields' weights, all in one pass over the token table.

    ``entries``: (query_id, term, and a column for each field of the first set, and one that is added as it is); in every trial
    both sides' vectors are their fields' sums with the trial's weights, scaled to length 1. Queries without one are left out.
    """
    w = W.partitionBy("trial", "query_id").orderBy(F.desc("score"), "doc_id")
    found = _searched(index, entries, k, grid, weights, True)
    return found.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def _searched(index: DataFrame, entries: DataFrame, k: int, grid: list[dict[str, float]], weights: Callable, unit: bool) -> DataFrame:
    """(query_id, doc_id, score, trial): the k best of every task."""
    spark, fields, held = index.sparkSession, list(grid[0]), cut(entries)
    n, size = held.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("term")), F.lit(0))).first()
    # a task keeps k rows a query, so there are as many tasks as cores
    index, out = index.coalesce(spark.sparkContext.defaultParallelism), None
    for block in blocks(held, "query_id", n, size) if n else ():
        if block.num_rows:
            sent = spark.sparkContext.broadcast(Index(block))
            columns = [c for f in fields for c in (f, f"{f}_tf", f"{f}_len")]
            shares = np.array([[g[f] for f in fields] for g in grid], float)
            found = index.select("doc_id", *columns).mapInArrow(_sparse_task(sent, shares, weights, unit, k, len(entries.columns) > 3), SCHEMA + ", trial long")
            out = found if out is None else out.union(found)
    return spark.createDataFrame([], SCHEMA + ", trial long") if out is None else out


def _sparse_task(sent, grid: np.ndarray, weights: Callable, unit: bool, k: int, added: bool) -> Callable:
    """``added``: whether the queries' fields are added as the texts' are, in every trial of ``grid``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = sent.value
        best = [Best(x.queries, k) for _ in grid]
        for b in batches:
            row, code, parts, seen = text_parts(b, grid.shape[1], weights)
            term = pc.fill_null(pc.index_in(seen, x.terms), -1).to_numpy(zero_copy_only=False)[code]
            known = term >= 0
            for shares, one in zip(grid, best):
                value = summed(row, parts, shares, unit, b.num_rows)
                x.offer(one, b.column(0).to_numpy(), row[known], term[known], value[known], np.append(shares, 1.0) if added else None)
        for no, one in enumerate(best):
            some = one.batch(x.asked(np.append(grid[no], 1.0)) if added else None)
            yield some.append_column("trial", pa.array(np.full(some.num_rows, no)))

    return run


def _vectors(column: pa.ChunkedArray | pa.Array, n: int) -> np.ndarray:
    flat = pc.list_flatten(column)
    flat = flat.combine_chunks() if isinstance(flat, pa.ChunkedArray) else flat
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 0))


def dense_search(docs: DataFrame, queries: DataFrame, k: int, vector: str = "embedding", epsilon: float = 0.0) -> DataFrame:
    """(query_id, doc_id, score, rank) by cosine; zero vectors score 0. ``docs`` and ``queries`` have doc_id and vector."""
    spark = docs.sparkSession
    asked = queries.select("doc_id", vector).where(F.col(vector).isNotNull())
    n = asked.agg(F.coalesce(F.sum(F.size(vector)), F.lit(0))).first()[0]
    if not n:
        return ranked(_empty(spark), k)
    out = None
    for block in blocks(asked, "doc_id", n, 0):
        if not block.num_rows:
            continue
        sent = spark.sparkContext.broadcast((block.column(0).to_numpy(), _vectors(block.column(1), block.num_rows)))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            qid, q = sent.value
            qn, best = np.sqrt((q * q).sum(1)), Best(qid, k)
            for b in batches:
                d = _vectors(b.column(1), len(b))
                for lo in range(0, len(d), 1024):
                    part = d[lo : lo + 1024]
                    down = np.sqrt((part * part).sum(1))[:, None] * qn[None, :] + epsilon
                    best.offer(b.column(0).to_numpy()[lo : lo + 1024], np.divide(part @ q.T, down, out=np.zeros(down.shape), where=down != 0))
            yield best.batch()

        found = docs.where(F.col(vector).isNotNull()).select("doc_id", vector).mapInArrow(run, SCHEMA)
        out = found if out is None else out.union(found)
    return ranked(out, k)


def dense_scores(docs: DataFrame, queries: DataFrame, vector: str = "embedding", epsilon: float = 0.0) -> DataFrame:
    """(query_id, doc_id, score): the cosine of every document to each of a bounded query set; nothing is shuffled.

    For methods that need a number at every document. A query set above ``ENTRIES`` numbers raises.
    """
    asked = queries.select("doc_id", vector).where(F.col(vector).isNotNull())
    if asked.agg(F.coalesce(F.sum(F.size(vector)), F.lit(0))).first()[0] > ENTRIES:
        raise ValueError("the query set is too large to be scored against every document at once")
    table = asked.toArrow()
    sent = docs.sparkSession.sparkContext.broadcast((table.column(0).to_numpy(), _vectors(table.column(1), table.num_rows)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qid, q = sent.value
        qn = np.sqrt((q * q).sum(1))
        for b in batches:
            d, ids = _vectors(b.column(1), len(b)), b.column(0).to_numpy()
            if not len(d) or not len(q):
                continue
            down = np.sqrt((d * d).sum(1))[:, None] * qn[None, :] + epsilon
            scores = np.round(np.divide(d @ q.T, down, out=np.zeros(down.shape), where=down != 0), 9) + 0.0
            columns = [np.tile(qid, len(ids)), np.repeat(ids, len(qid)), scores.reshape(-1)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query_id", "doc_id", "score"])

    return docs.where(F.col(vector).isNotNull()).select("doc_id", vector).mapInArrow(run, SCHEMA)
