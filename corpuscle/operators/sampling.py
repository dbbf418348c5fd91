"""Deterministic sampling and splitting by hashes; the same on every run and every partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hash_order(key: Column, seed: int | str = 42) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), key.cast("string")))


def sample(rows: DataFrame, key: str, n: int, seed: int | str = 42) -> DataFrame:
    """The n rows of least hash; a seed of 0 counts like any other."""
    return rows.orderBy(hash_order(F.col(key), seed), key).limit(n)


def split(rows: DataFrame, key: str, shares: dict[str, float], seed: int | str = 42) -> DataFrame:
    """Rows with a column ``split``: each key falls into a part with about its share; no shuffle."""
    u = F.conv(F.substring(hash_order(F.col(key), seed), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    out, low = F.lit(list(shares)[-1]), 0.0
    bounds = []
    for name, share in shares.items():
        low += share
        bounds.append((name, low))
    for name, high in reversed(bounds[:-1]):
        out = F.when(u < high, name).otherwise(out)
    return rows.withColumn("split", out)


def grouped_sample(qrels: DataFrame, docs: DataFrame, budget: int, seed: int = 42) -> DataFrame:
    """Ids of about ``budget`` documents that keep queries together with all their candidates.

    Groups (a query and its candidates) are taken in hash order; a group that does not fit is passed over. What is left
    of the budget is filled with other documents in hash order. Greedy packing is sequential: the driver walks over the
    groups of at most the budget's size (ids only, streamed) until not even two documents have room.
    """
    pairs = qrels.select("query_id", "candidate_id").distinct()
    fits = pairs.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") <= budget)
    groups = pairs.join(fits.select("query_id"), "query_id").groupBy("query_id").agg(F.collect_set("candidate_id").alias("c"))
    taken: set[str] = set()
    for r in groups.orderBy(hash_order(F.col("query_id"), seed), "query_id").toLocalIterator():
        group = {r["query_id"], *r["c"]}
        if len(taken | group) <= budget:
            taken |= group
        if len(taken) >= budget - 1:
            break
    spark = docs.sparkSession
    ids = spark.createDataFrame([(x,) for x in sorted(taken)], "id string")
    rest = docs.select("id").distinct().join(ids, "id", "left_anti")
    fill = sample(rest, "id", budget - len(taken), seed)
    return ids.union(fill)
