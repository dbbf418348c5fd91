"""References to records that do not exist (problem 5), and joins on rendered ids.

Existence of a key is a signed count: +1 when a row with that key is ingested, -1 when it is removed. The deltas are
summed per (key, time), then turned into running counts by two window steps (within a day of a key, and over the days
of a key), so that one task gets at most the times of a day of a key, or its days. References are counted in the same
deltas: those of a time at which the key's count of references is positive and that of existence is zero are orphans.
``existence_periods`` has the disjoint periods in which a key exists; there the turns of a key are ordered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: What an id may be wrapped in: blanks of any kind, a number sign, leading zeros, a decimal fraction of zeros.
ID_PATTERN = r"(?U)^[\s\p{Z}​﻿]*#?[\s\p{Z}]*0*([0-9]+?)(?:\.0*)?[\s\p{Z}​﻿]*$"


def spelled_number(entry: Column) -> Column:
    """The number an entry spells, in plain digits; null where it spells none."""
    return F.nullif(F.regexp_extract(entry, ID_PATTERN, 1), F.lit(""))


def existence_deltas(rows: DataFrame, key: str, begin: str, end: str) -> DataFrame:
    """(key, at, n): the changes of the number of rows of a key, without zeros."""
    ok = rows.where(F.col(key).isNotNull() & F.col(begin).isNotNull() & (F.col(end).isNull() | (F.col(end) > F.col(begin))))
    deltas = ok.select(
        F.col(key).alias("key"),
        F.explode(
            F.array(
                F.struct(F.col(begin).alias("at"), F.lit(1).alias("n")), F.struct(F.col(end).alias("at"), F.lit(-1).alias("n"))
            )
        ).alias("d"),
    ).where("d.at is not null")
    return deltas.groupBy("key", F.col("d.at").alias("at")).agg(F.sum("d.n").alias("n")).where("n <> 0")


def running(net: DataFrame) -> DataFrame:
    """(key, at, now, n, further columns): ``now`` is the sum of n of the key up to and with this time; one row a key and time."""
    rest = [c for c in net.columns if c not in ("key", "at", "n")]
    day = F.date_trunc("day", "at")
    net = net.withColumn("day", day)
    within = net.withColumn(
        "c", F.sum("n").over(W.partitionBy("key", "day").orderBy("at").rowsBetween(W.unboundedPreceding, 0))
    )
    before = net.groupBy("key", "day").agg(F.sum("n").alias("n"))
    before = before.select(
        "key", "day",
        F.coalesce(F.sum("n").over(W.partitionBy("key").orderBy("day").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("b"),
    )
    return within.join(before, ["key", "day"]).select("key", "at", (F.col("b") + F.col("c")).alias("now"), "n", *rest)


def existence_periods(rows: DataFrame, key: str, begin: str, end: str) -> DataFrame:
    """(key, opens, closes): disjoint periods [opens, closes) in which at least one row of the key exists.

    Rows without key or begin never exist; a null end means still there; rows that end before they begin never exist.
    ``closes`` is null for a period that is still open.
    """
    count = running(existence_deltas(rows, key, begin, end))
    turns = count.where((F.col("now") > 0) != (F.col("now") - F.col("n") > 0))
    spans = turns.withColumn("closes", F.lead("at").over(W.partitionBy("key").orderBy("at")))
    return spans.where("now > 0").select("key", F.col("at").alias("opens"), "closes")


def orphans(references: DataFrame, net: DataFrame) -> DataFrame:
    """The distinct rows of ``references`` (with columns target_id and at) whose target does not exist at their time.

    ``net`` are the existence deltas. References without a target or a time are none.
    """
    refs = references.where("target_id is not null and at is not null").distinct()
    asked = refs.groupBy(F.col("target_id").alias("key"), "at").agg(F.lit(0).cast("long").alias("n"), F.count("*").alias("refs"))
    both = net.withColumn("refs", F.lit(0).cast("long")).unionByName(asked).groupBy("key", "at").agg(F.sum("n").alias("n"), F.sum("refs").alias("refs"))
    lost = running(both).where("refs > 0 and now <= 0").select(F.col("key").alias("target_id"), "at")
    return refs.join(lost, ["target_id", "at"], "left_semi").select(*references.columns)


def document_references(documents: DataFrame, qrels: DataFrame) -> DataFrame:
    """(src_table, src_id, target_id, at): what documents and qrels refer to."""
    d = documents.select(
        F.lit("documents").alias("src_table"), F.col("id").alias("src_id"),
        F.explode("explicit_related_ids").alias("entry"), F.col("ingested_at").alias("at"),
    )
    q = qrels.select(
        F.lit("qrels").alias("src_table"), F.col("query_id").alias("src_id"),
        F.explode("candidate_ids").alias("entry"), F.col("judged_at").alias("at"),
    )
    return d.unionByName(q).select("src_table", "src_id", spelled_number(F.col("entry")).alias("target_id"), "at")


def found(documents: DataFrame, qrels: DataFrame) -> DataFrame:
    """(src_table, src_id, target_id, period): the orphan references with their month."""
    net = existence_deltas(documents, "id", "ingested_at", "removed_at")
    out = orphans(document_references(documents, qrels), net)
    return out.select("src_table", "src_id", "target_id", F.date_format("at", "yyyy-MM").alias("period")).distinct()


def report(documents: DataFrame, qrels: DataFrame) -> DataFrame:
    """(src_table, period, orphan_refs, orphan_targets), one row a table and month."""
    return found(documents, qrels).groupBy("src_table", "period").agg(
        F.count("*").alias("orphan_refs"), F.count_distinct("target_id").alias("orphan_targets")
    )
