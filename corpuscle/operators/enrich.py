"""Enrichment of canonical documents: metadata and hierarchy caches, citation queries, and the stage runner."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscle.functions.structured import parse_hierarchy


def with_metadata(papers: DataFrame, cache: DataFrame) -> DataFrame:
    """Documents left-joined with paper metadata on native_id.

    ``cache``: (corpus_id, meta). Where metadata exist, people, sorted distinct organizations and topics are replaced
    and the categorical keys written; other documents stay as they are.
    """
    d = papers.join(cache.withColumnRenamed("corpus_id", "native_id"), "native_id", "left")
    m, some = F.col("meta"), F.col("meta").isNotNull()
    orgs = F.array_sort(F.array_distinct(F.flatten(F.transform(m.authors, lambda a: F.coalesce(a.affiliations, F.array().cast("array<string>"))))))
    categorical = F.to_json(
        F.struct(
            m.publicationVenue["name"].alias("venue_name"), m.publicationVenue["type"].alias("venue_type"), m.journal["name"].alias("journal"),
            m.journal["volume"].alias("journal_volume"), m.fieldsOfStudy.alias("fields_of_study"), m.publicationTypes.alias("publication_types"),
        ),
        {"ignoreNullFields": "false"},
    )
    new = {"people": F.transform(m.authors, lambda a: a["name"]), "organizations": orgs, "topics": m.fieldsOfStudy, "categorical": categorical}
    return d.withColumns({c: F.when(some, v).otherwise(F.col(c)) for c, v in new.items()}).drop("meta")


def with_hierarchy(papers: DataFrame, cache: DataFrame) -> DataFrame:
    """Documents left-joined with the hierarchy cache (native_id, hierarchy_info).

    A hierarchy without errors is kept; a document that is not in the cache stays; a text that cannot be read gives its
    error code.
    """
    d = papers.join(cache.withColumn("cached", F.lit(True)), "native_id", "left")
    done = (F.length(F.regexp_replace("hierarchical", r"[\s{}\[\]]", "")) > 0) & ~F.col("hierarchical").contains('"errors"')
    p = parse_hierarchy(F.col("hierarchy_info"))
    error = F.to_json(F.struct(F.array(p.error).alias("errors")))
    new = F.when(p.error.isNotNull(), error).otherwise(p.value)
    return d.withColumn("hierarchical", F.when(done | F.col("cached").isNull(), F.col("hierarchical")).otherwise(new)).drop("cached", "hierarchy_info")


def citation_queries(docs: DataFrame, most: int = 200, seed: str = "42") -> DataFrame:
    """(query_id, candidate_ids, relation_type): up to ``most`` papers with references as queries, in hash order."""
    papers = docs.where((F.col("source_type") == "paper") & (F.size("explicit_related_ids") > 0))
    picked = papers.orderBy(F.md5(F.concat_ws("|", F.lit(seed), "id")), "id").limit(most)
    return picked.select(F.col("id").alias("query_id"), F.col("explicit_related_ids").alias("candidate_ids"), F.lit("citation").alias("relation_type"))


def enriched(docs: DataFrame, stages: list[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """The documents after all stages; at least one is required."""
    if not stages:
        raise ValueError("no enrichment stage given")
    for stage in stages:
        docs = docs.transform(stage)
    return docs


def enriched_dataset(docs: DataFrame, qrels: DataFrame, stages: list[Callable]) -> tuple[DataFrame, DataFrame]:
    """Documents and qrels after all stages, each of which maps both."""
    if not stages:
        raise ValueError("no enrichment stage given")
    for stage in stages:
        docs, qrels = stage(docs, qrels)
    return docs, qrels
