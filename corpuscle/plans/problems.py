"""Queries of the general data problems and their SQL, where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.operators import nested, packed, references
from corpuscle.session import table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return nested.issue_children(table(spark, d, "issues_raw"))


def p2_tables(spark: SparkSession, d: str) -> DataFrame:
    """Rows of each table that shared inlining makes of the raw issues."""
    rows = nested.shred(table(spark, d, "issues_raw"), "raw_id", "payload")
    return rows.groupBy("tbl", "parent_tbl").agg(F.count("*").alias("n_rows"), F.count_distinct("raw_id").alias("n_records"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return references.found(table(spark, d, "documents"), table(spark, d, "qrels"))


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    return references.report(table(spark, d, "documents"), table(spark, d, "qrels"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    known = table(spark, d, "label_mapping").select(F.col("raw_label").alias("val")).where("val is not null")
    return packed.issue_values(table(spark, d, "issues_df"), known=known)


_ORPHANS = r"""
WITH entries AS (
  SELECT 'documents' AS src_table, id AS src_id, unnest(explicit_related_ids) AS entry, ingested_at AS t FROM documents
  UNION ALL
  SELECT 'qrels', query_id, unnest(candidate_ids), judged_at FROM qrels
), refs AS (
  SELECT DISTINCT src_table, src_id, t,
         regexp_extract(entry, '^\s*#?\s*0*([0-9]+?)(\.0*)?\s*$', 1) AS target_id
  FROM entries WHERE entry IS NOT NULL AND t IS NOT NULL
), orphan AS (
  SELECT DISTINCT src_table, src_id, target_id, strftime(t, '%Y-%m') AS period FROM refs r
  WHERE target_id <> '' AND NOT EXISTS (
    SELECT 1 FROM documents d WHERE d.id = r.target_id AND d.ingested_at <= r.t
      AND (d.removed_at IS NULL OR d.removed_at > r.t))
)
"""

QUERIES = {f.__name__: f for f in (p2_found, p2_tables, p5_found, p5_report, p6_found)}

SQL = {
    "p5_found": _ORPHANS + "SELECT src_table, src_id, target_id, period FROM orphan",
    "p5_report": _ORPHANS + """SELECT src_table, period, count(*) AS orphan_refs, count(DISTINCT target_id) AS orphan_targets
FROM orphan GROUP BY ALL""",
}
