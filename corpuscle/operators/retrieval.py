"""Retrieval methods over canonical documents: BM25, lexical dense, field-weighted, graph expansion and propagation.

A corpus has doc_id (long), id, source_type, title, main_text, labels (text), is_candidate. A query set is a selection of
the same documents. All queries of a method are scored at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpuscle.functions.structured import metadata_text, useless_metadata
from corpuscle.functions.text import blank, prepared
from corpuscle.functions.vectors import cosine
from corpuscle.operators.search import bm25_weights, dense_search, lexical_weights, ranked, sparse_search, sparse_trials, term_index, unsettled, without_self
from corpuscle.session import cut

K1, B, EPSILON = 1.5, 0.75, 0.25
#: Field weights of the field-weighted method.
FIELDS = {"metadata": 1.0, "title": 1.0, "main_text": 2.0}


def latest(docs: DataFrame) -> DataFrame:
    """One row for each id: the last ingested (ties: larger doc_id). Only keys are shuffled, then rows are semi-joined."""
    return docs.join(latest_ids(docs).select("doc_id"), "doc_id", "left_semi")


def latest_ids(docs: DataFrame) -> DataFrame:
    """(id, doc_id): the row that holds for each id; rows without an id hold each for itself."""
    named = docs.where("id is not null").groupBy("id").agg(F.max(F.struct("ingested_at", "doc_id")).alias("last")).select("id", "last.doc_id")
    return named.union(docs.where("id is null").select("id", "doc_id"))


def candidates(docs: DataFrame) -> DataFrame:
    return docs.where(F.coalesce(F.col("is_candidate"), F.lit(True)))


def with_texts(docs: DataFrame) -> DataFrame:
    """The text columns the methods read: plain, labelled, and the fields."""
    labels = metadata_text(F.col("categorical"), F.col("hierarchical"))
    return docs.select(
        "doc_id", "id", "source_type", "source_dataset", "is_candidate",
        prepared(F.col("title"), None, F.col("main_text")).alias("plain"),
        prepared(F.col("title"), labels, F.col("main_text")).alias("labelled"),
        labels.alias("metadata"), F.coalesce("title", F.lit("")).alias("title"), F.coalesce("main_text", F.lit("")).alias("main_text"),
        useless_metadata(F.col("categorical"), F.col("hierarchical")).alias("useless"),
    )


def inverse_frequencies(index: DataFrame, text: str) -> tuple[DataFrame, float]:
    """(term, idf) over a token table, negative values raised to EPSILON times the mean; and the mean length."""
    n, avgdl = index.agg(F.count("*"), F.avg(f"{text}_len")).first()
    df = index.select(F.explode(text).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    raw = df.select("term", (F.ln(F.lit(float(n)) - F.col("df") + 0.5) - F.ln(F.col("df") + 0.5)).alias("raw"))
    floor = raw.agg((F.avg("raw") * EPSILON).alias("floor"))
    idf = raw.crossJoin(F.broadcast(floor)).select("term", F.when(F.col("raw") < 0, F.col("floor")).otherwise(F.col("raw")).alias("idf"))
    return idf, float(avgdl or 1.0)


def term_counts(index: DataFrame, text: str) -> DataFrame:
    """(query_id, term, tf) of a token table."""
    pairs = F.explode(F.arrays_zip(F.col(text).alias("term"), F.col(f"{text}_tf").alias("tf"))).alias("p")
    return index.select(F.col("doc_id").alias("query_id"), pairs).select("query_id", "p.term", F.col("p.tf").cast("long").alias("tf"))


def bm25(docs: DataFrame, queries: DataFrame, k: int = 10, text: str = "plain", judged: DataFrame | None = None) -> DataFrame:
    """k + 1 results for each query before the query's own document is taken out. With ``judged`` (query_id, doc_id), queries none of whose judged documents are among them may be left out."""
    index = cut(term_index(docs, [text]))
    idf, avgdl = inverse_frequencies(index, text)
    entries, weights = term_counts(term_index(queries, [text]), text).join(idf, "term").select("query_id", "term", (F.col("tf") * F.col("idf")).alias("weight")), bm25_weights(avgdl, K1, B)
    if judged is not None:
        vectors = cut(entries.groupBy("query_id").agg(F.collect_list(F.struct("term", "weight")).alias("p")).select("query_id", F.col("p.term").alias("q_term"), F.col("p.weight").alias("q_value")))
        stay = cut(unsettled(index, vectors, judged, k + 1, text, weights))
        all_ = F.explode(F.arrays_zip(F.col("q_term").alias("term"), F.col("q_value").alias("weight"))).alias("p")
        entries = vectors.join(stay, "query_id", "left_semi").select("query_id", all_).select("query_id", "p.term", "p.weight")
    return without_self(sparse_search(index, entries, k + 1, {text: 1.0}, weights))


def lexical_entries(index: DataFrame, fields: dict[str, Column]) -> DataFrame:
    """(query_id, term, weight): the lexical encoder on each text, added with the fields' weights (a column each).

    The sum is scaled to length 1, so that a dot product with a document's vector is their cosine. ``index`` is a token
    table with the columns that the weights need.
    """
    parts = None
    for text, share in fields.items():
        some = index.where(share > 0)
        w = F.transform(f"{text}_tf", lambda n: 1 + F.ln(n.cast("double")))
        length = F.sqrt(F.aggregate(w, F.lit(0.0), lambda s, x: s + x * x))
        # what stands beside an explode is worked out again for each of its rows
        one = some.select(F.col("doc_id").alias("query_id"), (share / length).alias("scale"), F.arrays_zip(F.col(text).alias("term"), w.alias("w")).alias("all"))
        one = one.select("query_id", "scale", F.explode("all").alias("p")).select("query_id", "p.term", (F.col("p.w") * F.col("scale")).alias("w"))
        parts = one if parts is None else parts.union(one)
    summed = parts.groupBy("query_id", "term").agg(F.sum("w").alias("w"))
    return summed.select("query_id", "term", (F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(W.partitionBy("query_id")))).alias("weight"))


def field_entries(index: DataFrame, fields: list[str]) -> DataFrame:
    """(query_id, term, a column for each field, alone): the lexical encoder on each field by itself.

    Queries without useful metadata have their main text as ``alone``, whatever the fields' weights, and nothing else.
    """
    use, parts = ~blank(F.col("metadata_text")) & ~F.col("useless"), None
    for text in fields:
        w = F.transform(f"{text}_tf", lambda n: 1 + F.ln(n.cast("double")))
        length = F.sqrt(F.aggregate(w, F.lit(0.0), lambda s, x: s + x * x))
        some = index if text == "main_text" else index.where(use)
        place = F.when(use, F.lit(text)).otherwise(F.lit("alone")) if text == "main_text" else F.lit(text)
        one = some.select(F.col("doc_id").alias("query_id"), place.alias("field"), length.alias("length"), F.explode(F.arrays_zip(F.col(text).alias("term"), w.alias("w"))).alias("p"))
        one = one.select("query_id", "p.term", "field", (F.col("p.w") / F.col("length")).alias("w"))
        parts = one if parts is None else parts.union(one)
    total = lambda c: F.sum(F.when(F.col("field") == c, F.col("w")).otherwise(0.0)).alias(c)
    return parts.groupBy("query_id", "term").agg(*[total(c) for c in [*fields, "alone"]])


def lexical_dense(docs: DataFrame, queries: DataFrame, k: int = 10, text: str = "plain", extra: int = 1, judged: DataFrame | None = None) -> DataFrame:
    """Cosine of lexical vectors; k + ``extra`` results before self-exclusion. ``judged`` as in :func:`bm25`."""
    # every block of queries reads the token table again
    index, asked = cut(term_index(docs, [text])), term_index(queries, [text])
    if judged is not None:
        asked = cut(asked.where(F.size(text) > 0))
        vectors = asked.select(F.col("doc_id").alias("query_id"), F.col(text).alias("q_term"), F.col(f"{text}_tf").alias("q_value"))
        stay = cut(unsettled(index, vectors, judged, k + extra, text, lexical_weights, lexical_weights))
        asked = asked.join(stay.select(F.col("query_id").alias("doc_id")), "doc_id", "left_semi")
    return without_self(sparse_search(index, lexical_entries(asked, {text: F.lit(1.0)}), k + extra, {text: 1.0}, lexical_weights))


def charm_shares(fields: dict[str, float]) -> dict[str, Column]:
    """The weight of each field in a query's vector; without useful metadata only its main text counts."""
    use = ~blank(F.col("metadata_text")) & ~F.col("useless")
    return {c: F.when(use, F.lit(w)).otherwise(F.lit(1.0 if c == "main_text" else 0.0)) for c, w in fields.items()}


def charm_queries(queries: DataFrame, fields: list[str]) -> DataFrame:
    """The token table of queries with what :func:`charm_shares` asks for."""
    return term_index(queries, fields).join(queries.select("doc_id", F.col("metadata").alias("metadata_text"), "useless"), "doc_id")


def charm(docs: DataFrame, queries: DataFrame, k: int = 10, fields: dict[str, float] | None = None) -> DataFrame:
    """Cosine of field-weighted vectors; queries without useful metadata are read by their main text only."""
    f = fields or FIELDS
    # each field reads the queries again, and their metadata text is costly
    entries = lexical_entries(cut(charm_queries(queries, list(f))), charm_shares(f))
    return without_self(sparse_search(cut(term_index(docs, list(f))), entries, k + 1, f, lexical_weights, unit=True))


def charm_trials(docs: DataFrame, queries: DataFrame, grid: list[dict[str, float]], k: int = 10) -> DataFrame:
    """(trial, query_id, doc_id, score, rank) for several sets of field weights; all trials share one pass over one token table."""
    names = list(dict.fromkeys(c for f in grid for c in f))
    index, asked = cut(term_index(docs, names)), cut(charm_queries(queries, names))
    found = sparse_trials(index, field_entries(asked, names), k + 1, [{c: f.get(c, 0.0) for c in names} for f in grid], lexical_weights)
    w = W.partitionBy("trial", "query_id").orderBy("rank")
    return found.where("doc_id <> query_id").withColumn("rank", F.row_number().over(w).cast("long")).select("trial", "query_id", "doc_id", "score", "rank")


def dense(docs: DataFrame, queries: DataFrame, k: int = 10, vector: str = "embedding", extra: int = 1, epsilon: float = 0.0) -> DataFrame:
    """Cosine of stored vectors; k + ``extra`` results before self-exclusion."""
    return without_self(dense_search(docs, queries, k + extra, vector, epsilon))


def expand(seeds: DataFrame, edges: DataFrame, index: DataFrame, k: int, graph_weight: float = 0.15) -> DataFrame:
    """One-hop graph expansion.

    ``seeds``: (query_id, doc_id, score, part); ``edges``: (src, dst, relation, weight, part); ``index``: (doc_id) that
    may be reached. Every seed spreads over its edges of both directions, weighted by their part of the seed's edge
    weights, by its score and by the neighbour's own score (1 if it is no seed of the same part).
    """
    e = edges.select("src", "dst", "weight", "part")
    both = e.select(F.col("src").alias("doc_id"), F.col("dst").alias("near"), "weight", "part").union(
        e.select(F.col("dst").alias("doc_id"), F.col("src").alias("near"), "weight", "part")
    )
    both = both.join(index.select(F.col("doc_id").alias("near")), "near", "left_semi")
    total = both.groupBy("doc_id", "part").agg((F.sum("weight") + 1e-10).alias("total"))
    spread = seeds.join(both, ["doc_id", "part"]).join(total, ["doc_id", "part"])
    own = seeds.select("query_id", "part", F.col("doc_id").alias("near"), F.col("score").alias("near_score"))
    spread = spread.join(own, ["query_id", "part", "near"], "left")
    near = F.greatest(F.lit(0.0), F.coalesce("near_score", F.lit(1.0)))
    add = graph_weight * F.col("score") * (F.col("weight") / F.col("total")) * near
    adds = spread.select("query_id", F.col("near").alias("doc_id"), add.alias("score"))
    final = seeds.select("query_id", "doc_id", "score").union(adds).groupBy("query_id", "doc_id").agg(F.round(F.sum("score"), 9).alias("score"))
    return without_self(ranked(final, k))


def propagate(
    start: DataFrame, edges: DataFrame, docs: DataFrame, queries: DataFrame, k: int, alphas: list[float], seeds: int = 5,
    vector: str = "embedding",
) -> DataFrame:
    """Min-message propagation of distances; the k nearest after the last round.

    ``start``: (query_id, doc_id, score), the nearest documents of each query, at least k plus as many as all rounds can
    touch; so the result is that of a propagation over all documents. Documents reached that are not in it get their
    distance from their vectors. ``edges``: (src, dst). In every round the ``seeds`` nearest send their distance along
    their edges; a receiver takes alpha of its own and the rest of the least message.
    """
    # repeated rows of an id count once: they would multiply in every round
    state = cut(start.groupBy("query_id", "doc_id").agg(F.round(1 - F.max("score"), 9).alias("h")))
    links = cut(edges.select("src", "dst").distinct())
    dv = docs.select(F.col("doc_id").alias("dst"), F.col(vector).alias("v")).dropDuplicates(["dst"])
    qv = queries.select(F.col("doc_id").alias("query_id"), F.col(vector).alias("qv")).dropDuplicates(["query_id"])
    for a in alphas:
        w = W.partitionBy("query_id").orderBy("h", "doc_id")
        s = state.withColumn("r", F.row_number().over(w)).where(F.col("r") <= seeds)
        m = s.join(links, s.doc_id == links.src).groupBy("query_id", "dst").agg(F.min("h").alias("m"))
        known = state.select("query_id", F.col("doc_id").alias("dst"), "h")
        got = m.join(known, ["query_id", "dst"], "left").join(dv, "dst").join(qv, "query_id")
        own = F.coalesce("h", F.round(1 - F.round(F.coalesce(cosine(F.col("v"), F.col("qv")), F.lit(0.0)), 9), 9))
        got = got.select("query_id", F.col("dst").alias("doc_id"), F.round(a * own + (1 - a) * F.col("m"), 9).alias("new"))
        # a round reads the state three times: without a checkpoint the plan would triple with every round
        state = cut(state.join(got, ["query_id", "doc_id"], "full").select("query_id", "doc_id", F.coalesce("new", "h").alias("h")))
    w = W.partitionBy("query_id").orderBy("h", "doc_id")
    top = state.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)
    return without_self(top.select("query_id", "doc_id", (1 - F.col("h")).alias("score"), "rank"))


def attention(
    features: DataFrame, edges: DataFrame, weight: list[float], to: list[float], of: list[float], slope: float = 0.2
) -> DataFrame:
    """(query_id, doc_id, out): one graph attention layer from a number per node to ``len(weight)`` numbers.

    ``features``: (query_id, doc_id, x); ``edges``: (src, dst), repetitions count. A node attends to its in-neighbours
    and itself with a softmax over leaky-rectified scores; ``to`` and ``of`` are the attention vectors of receiver and
    sender, ``weight`` is the linear map.
    """
    a_to, a_of = (sum(w * v for w, v in zip(weight, vec)) for vec in (to, of))
    loops = features.select("query_id", F.col("doc_id").alias("dst"), F.col("x").alias("sent"))
    sent = features.select("query_id", F.col("doc_id").alias("src"), F.col("x").alias("sent"))
    every = loops.union(sent.join(edges.where("src <> dst").select("src", "dst"), "src").select("query_id", "dst", "sent"))
    own = features.select("query_id", F.col("doc_id").alias("dst"), F.col("x").alias("own"))
    score = F.lit(a_to) * F.col("own") + F.lit(a_of) * F.col("sent")
    scored = every.join(own, ["query_id", "dst"]).withColumn("e", F.when(score > 0, score).otherwise(slope * score))
    # the softmax in one aggregation: scores are shifted by their maximum, which a window finds first
    shifted = scored.withColumn("p", F.exp(F.col("e") - F.max("e").over(W.partitionBy("query_id", "dst"))))
    mean = shifted.groupBy("query_id", "dst").agg((F.sum(F.col("p") * F.col("sent")) / F.sum("p")).alias("m"))
    return mean.select("query_id", F.col("dst").alias("doc_id"), F.array(*[F.lit(w) * F.col("m") for w in weight]).alias("out"))


def attend(features: DataFrame, edges: DataFrame, first: dict, second: dict, k: int) -> DataFrame:
    """The k smallest outputs of a two-layer attention network (one hidden layer, leaky-rectified) over distances.

    ``first`` and ``second`` hold weight, to and of; the second layer's weight maps the hidden numbers to one.
    """
    hidden = attention(features, edges, **first)
    leaky = F.transform("out", lambda v: F.when(v > 0, v).otherwise(0.01 * v))
    folded = F.aggregate(F.zip_with(leaky, F.array(*map(F.lit, second["weight"])), lambda v, w: v * w), F.lit(0.0), lambda s, v: s + v)
    one = attention(hidden.select("query_id", "doc_id", folded.alias("x")), edges, [1.0], second["to"], second["of"])
    return without_self(ranked(one.select("query_id", "doc_id", F.round(-F.col("out")[0], 9).alias("score")), k))
