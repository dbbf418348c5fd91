"""Sinks: JSON lines, results, caches, graphs, CSV and request files."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscle.operators.align import chunks


def json_lines(rows: DataFrame, path: str) -> None:
    """JSON lines in UTF-8 with explicit nulls."""
    rows.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def results(means: DataFrame, config: dict, path: str, details: DataFrame | None = None) -> None:
    """One JSON file with the configuration and every method's means; (method, metric, k, mean) is small by nature."""
    found: dict[str, dict] = {}
    for r in means.orderBy("method", "metric", "k").collect():
        name = f"{r['metric']}_mean" if r["k"] is None else f"{r['metric']}@{r['k']}_mean"
        found.setdefault(r["method"], {})[name] = r["mean"]
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        json.dump({"benchmark_config": config, "results": found}, f, indent=2, ensure_ascii=False)
    if details is not None:
        json_lines(details, f"{path}.details")


def cache(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def graph(edges: DataFrame, path: str) -> None:
    """Edges by relation, so that one relation can be read alone."""
    edges.write.mode("overwrite").partitionBy("relation").parquet(path)


def csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def requests(rows: DataFrame, path: str, order: str, size: int = 800) -> None:
    """Request lines, one folder for each chunk of ``size`` rows."""
    c = chunks(rows, [F.col(order)], size)
    c.select("chunk", F.to_json(F.struct(*[x for x in rows.columns])).alias("value")).write.mode("overwrite").partitionBy("chunk").text(path)


def _grouped(rows: DataFrame, key: str, size: int) -> tuple[DataFrame, int]:
    n = max(1, -(-rows.count() // size))
    return rows.withColumn("__g", F.pmod(F.xxhash64(key), F.lit(n))), n


def json_arrays(rows: DataFrame, path: str, key: str, size: int = 1000) -> None:
    """Files that each hold one JSON array of about ``size`` rows."""
    grouped, n = _grouped(rows, key, size)
    one = F.concat(F.lit("["), F.array_join(F.collect_list(F.to_json(F.struct(*rows.columns))), ","), F.lit("]")).alias("value")
    grouped.groupBy("__g").agg(one).repartition(n, "__g").write.mode("overwrite").partitionBy("__g").text(path)


def json_objects(rows: DataFrame, path: str, key: str, value: str, size: int = 1000) -> None:
    """Files that each hold one JSON object of about ``size`` entries, key to value."""
    grouped, n = _grouped(rows.where(F.col(key).isNotNull()), key, size)
    entry = F.regexp_extract(F.to_json(F.create_map(F.col(key), F.col(value))), r"(?s)^\{(.*)\}$", 1)
    one = F.concat(F.lit("{"), F.array_join(F.collect_list(entry), ","), F.lit("}")).alias("value")
    grouped.groupBy("__g").agg(one).repartition(n, "__g").write.mode("overwrite").partitionBy("__g").text(path)


def ids(rows: DataFrame, column: str, path: str) -> None:
    """The ids of a corpus, one a line."""
    rows.select(F.col(column).cast("string").alias("value")).where("value is not null").write.mode("overwrite").text(path)
