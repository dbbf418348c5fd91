"""Document graphs: edges from shared values, shared path prefixes and explicit links, and their statistics.

Buckets of documents that share a value are capped before they are paired, as the reference semantics demand: a larger
bucket carries no information and would be quadratic. The cap is counted by a partial aggregation, so a bucket of any
size costs one row a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscle.functions.text import blank
from corpuscle.operators.align import plain_id

CAP = 50


def valid_nodes(docs: DataFrame) -> DataFrame:
    """Documents with a non-blank title and main text."""
    return docs.where(~blank(F.col("title")) & ~blank(F.col("main_text")))


def attributes(docs: DataFrame) -> DataFrame:
    """Nodes of the document graphs (papers and issues) with what they are described by."""
    kinds = docs.where(F.col("source_type").isin("paper", "github_issue"))
    return valid_nodes(kinds).select(
        "doc_id", "id", F.col("source_type").alias("part"), "title", "main_text", "secondary_texts", "categorical", "hierarchical", "people",
        "organizations", "projects", "topics", "explicit_related_ids", "is_queryable", "is_candidate",
    )


def keys(docs: DataFrame, relation: str, values: Column, part: Column | None = None) -> DataFrame:
    """(relation, value, doc_id[, part]): one row for each value of a document, repetitions kept."""
    cols = [F.lit(relation).alias("relation"), F.explode(values).alias("value"), F.col("doc_id")]
    return docs.select(*cols, *([] if part is None else [part.alias("part")]))


def capped(keyed: DataFrame, cap: int = CAP) -> DataFrame:
    """Keys of buckets with at most ``cap`` rows; buckets of one row, which make no edge, are left out too."""
    on = [c for c in keyed.columns if c != "doc_id"]
    small = keyed.groupBy(*on).agg(F.count("*").alias("n")).where(F.col("n").between(2, cap)).drop("n")
    return keyed.join(small, on, "left_semi")


def shared_edges(keyed: DataFrame, weight: float, nodes: DataFrame | None = None, cap: int = CAP) -> DataFrame:
    """(src, dst, relation, weight[, part]) of both directions; weights of several shared values add up."""
    k = capped(keyed.distinct(), cap)
    on = [c for c in k.columns if c != "doc_id"]
    pairs = k.withColumnRenamed("doc_id", "src").join(k.withColumnRenamed("doc_id", "dst"), on).where("src <> dst")
    rest = [c for c in on if c not in ("value", "relation")]
    edges = pairs.groupBy("src", "dst", "relation", *rest).agg((F.count("*") * F.lit(weight)).alias("weight"))
    return edges if nodes is None else among(edges, nodes)


def repeated_edges(keyed: DataFrame, cap: int = CAP) -> DataFrame:
    """(src, dst, n): edges of both directions with their number, one for each shared value and repetition.

    Repetitions of a value in one document count towards the cap.
    """
    k = capped(keyed, cap)
    on = [c for c in k.columns if c != "doc_id"]
    k = k.groupBy(*on, "doc_id").agg(F.count("*").alias("m"))
    a, b = k.withColumnRenamed("doc_id", "src"), k.withColumnRenamed("doc_id", "dst").withColumnRenamed("m", "l")
    return a.join(b, on).where("src <> dst").groupBy("src", "dst").agg(F.sum(F.col("m") * F.col("l")).alias("n"))


def among(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose both ends are nodes."""
    ids = nodes.select("doc_id")
    out = edges.join(ids.withColumnRenamed("doc_id", "src"), "src", "left_semi")
    return out.join(ids.withColumnRenamed("doc_id", "dst"), "dst", "left_semi").select(*edges.columns)


def explicit_edges(docs: DataFrame, relation: Column, nodes: DataFrame) -> DataFrame:
    """(src, dst, relation, weight): explicit links between nodes; no self-loops, repeated links add 1 each.

    Links name documents by id, rendered in any way; the edges are on doc_id.
    """
    ends = docs.select(F.col("doc_id").alias("src"), relation.alias("relation"), F.explode("explicit_related_ids").alias("entry"))
    ends = ends.select("src", "relation", plain_id(F.col("entry")).alias("id"))
    found = ends.join(docs.select("id", F.col("doc_id").alias("dst")), "id").where("src <> dst")
    return among(found.groupBy("src", "dst", "relation").agg(F.count("*").cast("double").alias("weight")), nodes)


def degrees(edges: DataFrame) -> DataFrame:
    """(doc_id, degree, neighbours): edges at a node (parallel ones each), and distinct neighbours."""
    both = edges.select(F.col("src").alias("doc_id"), F.col("dst").alias("near")).union(edges.select("dst", "src"))
    return both.groupBy("doc_id").agg(F.count("*").alias("degree"), F.count_distinct("near").alias("neighbours"))


def statistics(edges: DataFrame) -> DataFrame:
    """One row: nodes with edges, edges, mean and largest numbers of neighbours, and exact degree percentiles."""
    d = degrees(edges)
    p = F.percentile("degree", F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)))
    stats = d.agg(
        F.count("*").alias("n_nodes"), F.avg("neighbours").alias("avg_neighbours"), F.max("neighbours").alias("max_neighbours"),
        F.avg("degree").alias("avg_degree"), p.alias("p"), F.max("degree").alias("max_degree"),
    )
    names = ("median_degree", "p95_degree", "p99_degree")
    return stats.select("n_nodes", "avg_neighbours", "max_neighbours", "avg_degree", *[F.col("p")[i].alias(n) for i, n in enumerate(names)], "max_degree")


def hub(edges: DataFrame) -> DataFrame:
    """The node with most distinct neighbours (ties: smaller id)."""
    return degrees(edges).orderBy(F.desc("neighbours"), "doc_id").limit(1)


def relation_histogram(edges: DataFrame, doc_id: DataFrame) -> DataFrame:
    """(direction, relation, n) of the edges at the one node of ``doc_id``."""
    ins = edges.join(doc_id.select(F.col("doc_id").alias("dst")), "dst", "left_semi").select(F.lit("IN").alias("direction"), "relation")
    outs = edges.join(doc_id.select(F.col("doc_id").alias("src")), "src", "left_semi").select(F.lit("OUT").alias("direction"), "relation")
    return ins.union(outs).groupBy("direction", "relation").agg(F.count("*").alias("n"))


def link_members(links: DataFrame, key: str = "issue_key", via: str = "pull_url") -> DataFrame:
    """(via, key, n): the distinct members of every pull request and how many it has."""
    pairs = links.where(f"{key} is not null and {via} is not null").select(via, key).distinct()
    return pairs.join(pairs.groupBy(via).agg(F.count("*").alias("n")), via)


def linked(links: DataFrame, key: str = "issue_key", via: str = "pull_url", cap: int = CAP) -> DataFrame:
    """(key, related, hubs, n_links): issues that share a pull request.

    ``related`` lists the other issues of all pulls with at most ``cap`` issues; pulls of more issues are named in
    ``hubs``, and their issues are the rows that name them, so no link is lost and none is written out quadratically.
    ``n_links`` counts all links of an issue: the other issues of each of its pulls, large ones too. Both lists are sorted and
    distinct; issues without links have empty lists.
    """
    sized = link_members(links, key, via).where("n > 1")
    small = sized.where(F.col("n") <= cap).select(key, via)
    related = small.join(small.withColumnRenamed(key, "other"), via).where(F.col(key) != F.col("other")).groupBy(key).agg(F.array_sort(F.collect_set("other")).alias("related"))
    large = F.when(F.col("n") > cap, F.col(via))
    hubs = sized.groupBy(key).agg(F.array_sort(F.collect_set(large)).alias("hubs"), F.sum(F.col("n") - 1).alias("n_links"))
    out = links.where(f"{key} is not null").select(key).distinct().join(related, key, "left").join(hubs, key, "left")
    none = F.array().cast("array<string>")
    return out.select(key, F.coalesce("related", none).alias("related"), F.coalesce("hubs", none).alias("hubs"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def issue_qrels(links: DataFrame, ids: DataFrame, cap: int = CAP) -> DataFrame:
    """(query_id, candidate_id, pull_url, n): judgments of kind ``linked_issue`` between known issues (``ids``: issue_key, id).

    Pairs of issues that share a pull of at most ``cap`` known issues have null pull_url and n; an issue of a larger pull has one
    row with the pull and its number of issues and no candidate: its candidates are the other rows of that pull.
    """
    known = link_members(links.join(ids, "issue_key").select(F.col("id"), "pull_url"), "id").where("n > 1")
    small = known.where(F.col("n") <= cap).select("pull_url", F.col("id").alias("query_id"))
    pairs = small.join(small.withColumnRenamed("query_id", "candidate_id"), "pull_url").where("query_id <> candidate_id").select("query_id", "candidate_id").distinct()
    pairs = pairs.select("query_id", "candidate_id", F.lit(None).cast("string").alias("pull_url"), F.lit(None).cast("long").alias("n"))
    kind = dict(ids.dtypes)["id"]
    large = known.where(F.col("n") > cap).select(F.col("id").alias("query_id"), F.lit(None).cast(kind).alias("candidate_id"), "pull_url", "n")
    return pairs.union(large)
