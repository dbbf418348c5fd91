"""Queries of the retrieval, graph, alignment and evaluation operators over the test tables, and their SQL.

Documents are the last row of each id. The queries of the retrieval methods are the documents that have judgments with
known candidates; for stored vectors, every vector whose id is divisible by 100, against all vectors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.functions import structured, text
from corpuscle.operators import align, bench, enrich, graph, metrics, nested, retrieval, sampling, validate
from corpuscle.session import cut, table

K = 10
#: Field weights that are searched (fixed values), and the trials that are made.
WEIGHTS = {"metadata": [0.5, 1.0, 1.5, 2.0, 3.0, 4.0], "title": [0.5, 1.0, 1.5, 2.0, 3.0], "main_text": [0.5, 1.0, 1.5, 2.0]}
GRID = bench.settings(WEIGHTS, 20)
PRICES = {"nano": (0.05, 0.4), "mini": (0.25, 2.0)}
ALPHAS = [0.5] * 5

# inputs


def docs(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.latest(table(spark, d, "documents"))


def truth(spark: SparkSession, d: str) -> DataFrame:
    """(query_id, doc_id): judged pairs of known documents, by doc_id."""
    ids = cut(retrieval.latest_ids(table(spark, d, "documents")))
    long = align.long_qrels(table(spark, d, "qrels"))
    q = long.join(ids.select(F.col("id").alias("query_id"), F.col("doc_id").alias("q")), "query_id")
    c = q.join(ids.select(F.col("id").alias("candidate_id"), F.col("doc_id").alias("c")), "candidate_id")
    return c.select(F.col("q").alias("query_id"), F.col("c").alias("doc_id")).distinct()


def corpus(spark: SparkSession, d: str) -> DataFrame:
    """Documents with structured content, with the methods' text columns."""
    x = docs(spark, d)
    return retrieval.with_texts(x.where(structured.has_structure(F.col("source_type"), F.col("categorical"), F.col("hierarchical"))))


def asked(all_docs: DataFrame, judged: DataFrame) -> DataFrame:
    return all_docs.join(judged.select(F.col("query_id").alias("doc_id")).distinct(), "doc_id", "left_semi")


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding", "label")


def vector_edges(v: DataFrame) -> DataFrame:
    """Edges between vectors of one label and one part of its ids; a label has a part for every ten vectors, so that no part grows."""
    parts = v.groupBy("label").agg(F.ceil(F.count("*") / 10).alias("parts"))
    value = F.array(F.concat_ws("|", "label", F.col("doc_id") % F.col("parts")))
    return graph.shared_edges(graph.keys(v.join(parts, "label"), "share bucket", value, F.lit("v")), 0.5)


def out(ranking: DataFrame) -> DataFrame:
    """Scores with six digits; halves go up, computed in the same way in any engine."""
    return ranking.select("query_id", "doc_id", (F.floor(F.col("score") * 1e6 + 0.5) / 1e6).alias("score"), "rank")


# retrieval


def _bm25(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    c, t = corpus(spark, d), cut(truth(spark, d))
    return retrieval.bm25(retrieval.candidates(c), asked(c, t), K), t


def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return out(_bm25(spark, d)[0])


def bm25_metrics(spark: SparkSession, d: str) -> DataFrame:
    r, t = _bm25(spark, d)
    return metrics.evaluate(r, t.join(asked(corpus(spark, d), t).select(F.col("doc_id").alias("query_id")), "query_id", "left_semi"))


def bm25_metrics_mean(spark: SparkSession, d: str) -> DataFrame:
    return metrics.means(bm25_metrics(spark, d))


def bm25_details(spark: SparkSession, d: str) -> DataFrame:
    r, t = _bm25(spark, d)
    known = t.join(asked(corpus(spark, d), t).select(F.col("doc_id").alias("query_id")), "query_id", "left_semi")
    return metrics.details(r, known).withColumn("top_retrieved", F.array_join("top_retrieved", " "))


def _lexical(spark: SparkSession, d: str, column: str) -> DataFrame:
    c, t = corpus(spark, d), cut(truth(spark, d))
    return retrieval.lexical_dense(c.where("source_type <> 'query'"), asked(c, t), K, column)


def lexical_topk(spark: SparkSession, d: str) -> DataFrame:
    return out(_lexical(spark, d, "plain"))


def lexical_labels_topk(spark: SparkSession, d: str) -> DataFrame:
    return out(_lexical(spark, d, "labelled"))


def charm_topk(spark: SparkSession, d: str) -> DataFrame:
    c, t = corpus(spark, d), cut(truth(spark, d))
    return out(retrieval.charm(retrieval.candidates(c), asked(c, t), K))


def charm_param_search(spark: SparkSession, d: str) -> DataFrame:
    """Trials of field weights by their mean NDCG at 10, best first."""
    c, t = corpus(spark, d), cut(truth(spark, d))
    q = asked(c, t)
    known = t.join(q.select(F.col("doc_id").alias("query_id")), "query_id", "left_semi")
    found = cut(retrieval.charm_trials(retrieval.candidates(c), q, GRID, K))
    return bench.trial_means(found, known, K).orderBy(F.desc("ndcg"), "trial")


def method_comparison(spark: SparkSession, d: str) -> DataFrame:
    """Labelled against plain lexical vectors."""
    t = cut(truth(spark, d))
    known = t.join(asked(corpus(spark, d), t).select(F.col("doc_id").alias("query_id")), "query_id", "left_semi")
    one = [metrics.means(metrics.evaluate(_lexical(spark, d, x), known)) for x in ("labelled", "plain")]
    return metrics.compare(*one)


def comparison_summary(spark: SparkSession, d: str) -> DataFrame:
    return metrics.summary(method_comparison(spark, d))


def _dense(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    v = vectors(spark, d)
    q = v.where("doc_id % 100 = 0")
    same = q.select(F.col("doc_id").alias("query_id"), "label").join(v.select("doc_id", "label"), "label").where("query_id <> doc_id")
    return v, q, same.select("query_id", "doc_id")


def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    v, q, _ = _dense(spark, d)
    return out(retrieval.dense(v, q, K))


def dense_metrics_mean(spark: SparkSession, d: str) -> DataFrame:
    v, q, same = _dense(spark, d)
    return metrics.means(metrics.evaluate(retrieval.dense(v, q, K), same))


def sage_topk(spark: SparkSession, d: str) -> DataFrame:
    v, q, _ = _dense(spark, d)
    seeds = retrieval.dense_search(v, q, 2 * K, epsilon=1e-10).withColumn("part", F.lit("v"))
    return out(retrieval.expand(seeds, vector_edges(v), v, K))


def gnn_ret_topk(spark: SparkSession, d: str) -> DataFrame:
    v, q, _ = _dense(spark, d)
    # a bucket has at most CAP members, so five rounds of five seeds touch at most this many documents
    start = retrieval.dense_search(v, q, K + 5 * 5 * (graph.CAP - 1), epsilon=1e-10)
    return out(retrieval.propagate(start, vector_edges(v), v, q, K, ALPHAS))


def gat_base_topk(spark: SparkSession, d: str) -> DataFrame:
    v, q, _ = _dense(spark, d)
    return out(retrieval.dense(v, q, K, extra=0, epsilon=1e-10))


# graphs


def _fields(x: DataFrame) -> DataFrame:
    """The shared fields of papers and issues, each part by itself."""
    kind = F.when(F.col("source_type").isin("paper", "github_issue"), F.col("source_type"))
    x = x.withColumn("part", kind).where("part is not null")
    c = F.col("categorical")
    papers, issues = x.where("part = 'paper'"), x.where("part = 'github_issue'")
    parts = [graph.keys(papers, f"share {n}", structured.field_values(c, n), F.col("part")) for n in ("venue_name", "publication_types")]
    parts.append(graph.keys(papers, "share authors", structured.split_values(F.col("people")), F.col("part")))
    parts.append(graph.keys(issues, "share source_dataset", F.array("source_dataset"), F.col("part")))
    parts += [graph.keys(issues, f"share {n}", structured.split_values(F.col(n)), F.col("part")) for n in ("projects", "people", "organizations", "topics")]
    out_ = parts[0]
    for p in parts[1:]:
        out_ = out_.unionByName(p)
    return out_


def shared_field_edges(spark: SparkSession, d: str) -> DataFrame:
    x = docs(spark, d)
    return graph.shared_edges(_fields(x), 0.5, graph.valid_nodes(x)).select("src", "dst", "relation", "weight")


def hier_prefix_edges(spark: SparkSession, d: str) -> DataFrame:
    x = docs(spark, d).where("source_type in ('paper', 'github_issue')")
    values = F.flatten(F.transform(structured.paths(F.col("hierarchical")), structured.prefixes))
    keyed = graph.keys(x, "share hierarchical path", values, F.col("source_type"))
    return graph.shared_edges(keyed, 0.75, graph.valid_nodes(x)).select("src", "dst", "relation", "weight")


def entity_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges with multiplicity between documents that share people or organizations."""
    x = docs(spark, d)
    keyed = graph.keys(x, "people", structured.split_values(F.col("people"))).unionByName(
        graph.keys(x, "organizations", structured.split_values(F.col("organizations")))
    )
    return graph.repeated_edges(keyed)


def explicit_edges(spark: SparkSession, d: str) -> DataFrame:
    x = docs(spark, d).where("source_type in ('paper', 'github_issue')")
    relation = F.when(F.col("source_type") == "paper", "citation").otherwise("linked_issue")
    return graph.explicit_edges(x, relation, graph.valid_nodes(x))


def graph_degree_stats(spark: SparkSession, d: str) -> DataFrame:
    s = graph.statistics(shared_field_edges(spark, d))
    return s.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in s.dtypes])


def graph_hub(spark: SparkSession, d: str) -> DataFrame:
    return graph.hub(shared_field_edges(spark, d))


def graph_hub_relations(spark: SparkSession, d: str) -> DataFrame:
    e = cut(shared_field_edges(spark, d))
    return graph.relation_histogram(e, graph.hub(e))


def linked_issues(spark: SparkSession, d: str) -> DataFrame:
    got = graph.linked(table(spark, d, "links"))
    return got.select("issue_key", *[F.array_join(c, " ").alias(c) for c in ("related", "hubs")], "n_links")


# alignment and enrichment


def qrels_long(spark: SparkSession, d: str) -> DataFrame:
    return align.long_qrels(table(spark, d, "qrels"))


def qrels_valid(spark: SparkSession, d: str) -> DataFrame:
    return align.valid_qrels(align.long_qrels(table(spark, d, "qrels")), docs(spark, d).select("id"))


def link_issue_keys(spark: SparkSession, d: str) -> DataFrame:
    return align.with_issue_key(table(spark, d, "links"), table(spark, d, "issues_df"))


def label_normalize(spark: SparkSession, d: str) -> DataFrame:
    return align.normalised_labels(table(spark, d, "issues_df"), table(spark, d, "label_mapping"))


def label_counts(spark: SparkSession, d: str) -> DataFrame:
    n = label_normalize(spark, d).select(F.explode(F.split("normalized", "[|]")).alias("path")).where("path <> ''")
    return n.groupBy("path").agg(F.count("*").alias("n"))


def raw_issue_links(spark: SparkSession, d: str) -> DataFrame:
    """Links of the raw issues, whatever their shape."""
    return nested.issue_links(table(spark, d, "issues_raw"))


def _known_issues(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Issues with running ids, and their (issue_key, id)."""
    issues = align.numbered(table(spark, d, "issues_df").dropDuplicates(["issue_key"]), [F.col("issue_key")])
    return issues, cut(issues.select("issue_key", "id"))


def issue_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents of issues with running ids and the ids of related issues, flattened again.

    Issues of a pull with more than ``graph.CAP`` issues are related through the pull (``hubs``); ``n_links`` counts all links.
    """
    issues, ids = _known_issues(spark, d)
    known = graph.linked(table(spark, d, "links").join(ids.select("issue_key"), "issue_key", "left_semi"))
    links = known.select("issue_key", "related", "hubs", "n_links")
    related = align.resolved(links, "issue_key", "related", ids.select(F.col("issue_key").alias("native"), F.col("id").cast("string").alias("id")), "native", "related")
    docs_ = align.issue_documents(issues.withColumn("id", F.col("id").cast("string")), label_normalize(spark, d), related)
    flat = docs_.select(
        "id", "source_dataset", F.size("secondary_texts").alias("n_comments"), F.col("structured_fields.hierarchical").alias("hierarchical"),
        F.array_join("relations.explicit_related_ids", " ").alias("related"), F.col("raw_source.native_id").alias("native_id"),
    )
    more = links.select(F.col("issue_key").alias("native_id"), F.array_join("hubs", " ").alias("hubs"), "n_links")
    return flat.join(more, "native_id", "left").fillna({"hubs": "", "n_links": 0})


def issue_qrels(spark: SparkSession, d: str) -> DataFrame:
    """Judgments between issues that share a pull; those of large pulls by membership."""
    return graph.issue_qrels(table(spark, d, "links"), _known_issues(spark, d)[1])


def related_ids(spark: SparkSession, d: str) -> DataFrame:
    """Explicit references resolved to the row number of their document, in order."""
    x = docs(spark, d)
    ids = x.select(F.col("id").alias("native"), F.col("doc_id").alias("id"))
    got = align.resolved(x.select("doc_id", "explicit_related_ids"), "doc_id", "explicit_related_ids", ids, "native", "related")
    return got.select("doc_id", F.array_join("related", " ").alias("related"))


def id_assignment(spark: SparkSession, d: str) -> DataFrame:
    """Running ids: documents first, then links."""
    a = docs(spark, d).select(F.lit(0).alias("part"), F.col("doc_id").cast("string").alias("native"), F.md5("text").alias("content"))
    b = table(spark, d, "issues_df").select(F.lit(1).alias("part"), F.col("issue_key").alias("native"), F.md5("issue_body").alias("content")).distinct()
    return align.numbered(a.union(b), [F.col("part"), F.col("native")])


def chunking(spark: SparkSession, d: str) -> DataFrame:
    c = align.chunks(docs(spark, d).select("doc_id"), [F.col("doc_id")], 250)
    return c.groupBy("chunk").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))


def struct_filter(spark: SparkSession, d: str) -> DataFrame:
    x = docs(spark, d)
    return x.where(structured.has_structure(F.col("source_type"), F.col("categorical"), F.col("hierarchical"))).select("doc_id", "source_type")


def metadata_text(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", structured.metadata_text(F.col("categorical"), F.col("hierarchical")).alias("metadata"))


def prepared_text(spark: SparkSession, d: str) -> DataFrame:
    x = retrieval.with_texts(docs(spark, d))
    return x.select("doc_id", F.md5("labelled").alias("labelled_md5"), F.size(text.tokens(F.col("plain"))).cast("long").alias("n_tokens"))


def hier_paths(spark: SparkSession, d: str) -> DataFrame:
    """The path prefixes of every document with their numbers."""
    p = docs(spark, d).select("doc_id", F.explode(structured.paths(F.col("hierarchical"))).alias("p"))
    return p.select(F.explode(structured.prefixes(F.col("p"))).alias("prefix")).groupBy("prefix").agg(F.count("*").alias("n"))


def hierarchy_parse(spark: SparkSession, d: str) -> DataFrame:
    """Hierarchy texts read with repair, and how they fared."""
    x = docs(spark, d).select("doc_id", structured.parse_hierarchy(F.col("hierarchical")).alias("p"))
    return x.groupBy(F.coalesce("p.error", F.lit("none")).alias("error")).agg(F.count("*").alias("n"))


def metadata_enrich(spark: SparkSession, d: str) -> DataFrame:
    """Issues among the documents left-joined with their tracker rows (the last export of each key)."""
    i = table(spark, d, "issues_df").groupBy("issue_key").agg(F.max(F.struct("exported_at", "closed_at", "created_at")).alias("i"))
    x = docs(spark, d).where("source_type = 'github_issue'").select("doc_id", "native_id")
    return x.join(i, x.native_id == i.issue_key, "left").select("doc_id", "native_id", F.col("i.created_at").alias("created_at"), F.col("issue_key").isNotNull().alias("found"))


def citation_queries(spark: SparkSession, d: str) -> DataFrame:
    return enrich.citation_queries(docs(spark, d)).select("query_id", F.size("candidate_ids").cast("long").alias("n_candidates"), "relation_type")


# checks, sampling and small utilities


def doc_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Exact copies of texts: the first id and the number of copies."""
    return table(spark, d, "documents").where("text is not null").groupBy(F.md5("text").alias("text_md5")).agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"))


def duplicate_rows(spark: SparkSession, d: str) -> DataFrame:
    return validate.duplicates(table(spark, d, "documents").select("doc_id", "id"), ["id"])


def missing_ids(spark: SparkSession, d: str) -> DataFrame:
    """Issues that no link names."""
    i, li = table(spark, d, "issues_df").select("issue_key").distinct(), table(spark, d, "links").select("issue_key")
    return i.join(li, "issue_key", "left_anti")


def status_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"))


def validation_counts(spark: SparkSession, d: str) -> DataFrame:
    q = align.long_qrels(table(spark, d, "qrels"))
    n = q.agg(F.count("*").alias("n_pairs"), F.count_distinct("query_id").alias("n_queries"), F.count_distinct("candidate_id").alias("n_candidates"))
    return n.crossJoin(table(spark, d, "documents").agg(F.count("*").alias("n_rows"), F.count_distinct("id").alias("n_documents")))


def sanity_rules(spark: SparkSession, d: str) -> DataFrame:
    return validate.problems(docs(spark, d)).groupBy("problem").agg(F.count("*").alias("n"))


def common_people(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "documents").select(F.explode("people").alias("p"))
    return validate.most_common(x, F.col("p"), 30)


def cost_estimate(spark: SparkSession, d: str) -> DataFrame:
    t = docs(spark, d).where("source_type = 'paper'").select(F.size(text.tokens(text.prepared(F.col("title"), None, F.col("main_text")))).alias("n_tokens"))
    return validate.costs(t, PRICES, 200.0, batch=True)


def corpus_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return validate.fingerprint(table(spark, d, "documents"), ["id", "title", "main_text"])


def train_split(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "qrels").select("query_id").where("query_id is not null").distinct()
    return sampling.split(q, "query_id", {"train": 0.1, "val": 0.15, "test": 0.75})


def query_sample(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "qrels").select("query_id").where("query_id is not null").distinct()
    return sampling.sample(q, "query_id", 100)


def sample_groups(spark: SparkSession, d: str) -> DataFrame:
    x = docs(spark, d).select("id")
    return sampling.grouped_sample(qrels_valid(spark, d), x, 500)


QUERIES = {
    f.__name__: f
    for f in (
        bm25_topk, bm25_metrics, bm25_metrics_mean, bm25_details, lexical_topk, lexical_labels_topk, charm_topk, charm_param_search,
        method_comparison, comparison_summary, dense_topk, dense_metrics_mean, sage_topk, gnn_ret_topk, gat_base_topk,
        shared_field_edges, hier_prefix_edges, entity_edges, explicit_edges, graph_degree_stats, graph_hub, graph_hub_relations,
        linked_issues, issue_qrels, qrels_long, qrels_valid, link_issue_keys, label_normalize, label_counts, raw_issue_links, issue_documents,
        related_ids, id_assignment, chunking, struct_filter, metadata_text, prepared_text, hier_paths, hierarchy_parse,
        metadata_enrich, citation_queries, doc_dedup, duplicate_rows, missing_ids, status_counts, validation_counts,
        sanity_rules, common_people, cost_estimate, corpus_fingerprint, train_split, query_sample, sample_groups,
    )
}
