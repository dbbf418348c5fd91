"""Sources: raw issues, papers, canonical JSON lines, caches, label maps, indexes, graphs and results.

Readers are lazy and take explicit schemas; nothing is inferred from data. Network sources are given as a function that
fetches one batch, so that the engine itself needs no network.
"""

from __future__ import annotations

import hashlib
import importlib.util
import json
import os
import random
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuscle import schema
from corpuscle.operators.align import numbered
from corpuscle.operators.validate import fingerprint


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def raw_issues(spark: SparkSession, path: str) -> DataFrame | None:
    """JSON arrays of raw issues in their nominal shape; None if the path does not exist."""
    return spark.read.schema(schema.RAW_ISSUE).option("multiLine", True).json(path) if _exists(spark, path) else None


def papers(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schema.PAPER).parquet(path)


def paper_queries(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schema.PAPER_QUERY).parquet(path)


def json_lines(spark: SparkSession, path: str, kind: T.StructType, strict: bool = True) -> DataFrame:
    """JSON lines; blank lines are skipped, malformed ones raise (or with ``strict`` off become null rows)."""
    return spark.read.schema(kind).option("mode", "FAILFAST" if strict else "PERMISSIVE").json(path)


def json_lines_strict(spark: SparkSession, path: str, kind: T.StructType) -> DataFrame:
    """JSON lines of which none may be blank; a blank or malformed one raises when it is read."""
    raised = F.raise_error(F.lit("a blank line"))
    checked = F.when(F.trim("value") == "", raised).otherwise(F.col("value"))
    return spark.read.text(path).select(F.from_json(checked, kind, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def documents(spark: SparkSession, path: str, source_type: str | None = None) -> DataFrame:
    """Canonical documents, of one type if given."""
    d = json_lines(spark, path, schema.DOCUMENT)
    return d if source_type is None else d.where(F.col("source_type") == source_type)


def unprocessed(docs: DataFrame, done: DataFrame, limit: int, key: str = "id") -> DataFrame:
    """The first papers by id that are not among the processed ones."""
    todo = docs.where((F.col("source_type") == "paper") & F.col(key).isNotNull()).join(done.select(key), key, "left_anti")
    return todo.orderBy(key).limit(limit)


def qrels(spark: SparkSession, path: str) -> DataFrame:
    """Judgments with ``candidate_ids`` or ``candidate_id``; a row with neither raises when it is read."""
    q = json_lines(spark, path, schema.QREL)
    both = F.coalesce("candidate_ids", F.when(F.col("candidate_id").isNotNull(), F.array("candidate_id")))
    checked = F.when(both.isNull(), F.raise_error(F.lit("a judgment has neither candidate_ids nor candidate_id"))).otherwise(both)
    return q.select("query_id", checked.alias("candidate_ids"), "relation_type")


def label_map(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, raw_label, normalized_path) of a CSV with header; the number is the place in the file."""
    rows = spark.read.option("header", True).schema("raw_label string, normalized_path string").csv(path)
    keyed = rows.select("raw_label", "normalized_path", F.monotonically_increasing_id().alias("at"))
    return numbered(keyed, [F.col("at")], 0, "line_no").select("line_no", "raw_label", "normalized_path")


def json_object(spark: SparkSession, path: str, value: T.DataType) -> DataFrame:
    """(key, value) of files that hold one JSON object of keyed entries."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", T.MapType(T.StringType(), value))).alias("key", "value"))


def metadata_cache(spark: SparkSession, path: str) -> DataFrame:
    return json_object(spark, path, schema.METADATA).select(F.col("key").alias("corpus_id"), F.col("value").alias("meta"))


def hierarchy_cache(spark: SparkSession, path: str) -> DataFrame:
    return json_object(spark, path, schema.HIERARCHY).select(F.col("key").alias("native_id"), "value.hierarchy_info", "value.error")


def cached(spark: SparkSession, path: str, names: list[str], build: Callable[[], dict[str, DataFrame]], use: bool = True) -> dict[str, DataFrame]:
    """Tables from a parquet cache; built and written if any of them is missing or the cache is not to be used."""
    if not (use and all(_exists(spark, f"{path}/{n}/_SUCCESS") for n in names)):
        built = build()
        for n in names:
            built[n].write.mode("overwrite").parquet(f"{path}/{n}")
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}


def graph(spark: SparkSession, path: str) -> DataFrame:
    """Edges of a stored graph; a missing one has no edges."""
    return spark.read.parquet(path) if _exists(spark, path) else spark.createDataFrame([], schema.EDGE)


def results(spark: SparkSession, path: str) -> DataFrame:
    """(method, metric, value) of result files, with or without the wrapping ``results`` object."""
    whole = spark.read.text(path, wholetext=True)
    inner = F.coalesce(F.get_json_object("value", "$.results"), F.col("value"))
    methods = whole.select(F.explode(F.from_json(inner, "map<string,string>")).alias("method", "m")).where("method <> 'benchmark_config'")
    values = methods.select("method", F.explode(F.from_json("m", "map<string,string>")).alias("metric", "value"))
    return values.select("method", "metric", F.expr("try_cast(value AS double)").alias("value")).where("value is not null")


class Status(Exception):
    """A service's answer with a status other than success."""

    def __init__(self, code: int):
        super().__init__(f"status {code}")
        self.code = code


#: Statuses after which a call is tried again (fixed values).
RETRIED = (429, 500, 502, 503, 504)


def with_backoff(call: Callable, tries: int = 6, first: float = 2.0, jitter: float = 0.5, sleep: Callable[[float], None] = time.sleep):
    """``call()`` with pauses that double, after an OSError or a status in ``RETRIED``; another status and the last error are raised."""
    wait = first
    for n in range(tries):
        try:
            return call()
        except (OSError, Status) as e:
            if n == tries - 1 or (isinstance(e, Status) and e.code not in RETRIED):
                raise
            sleep(wait + random.uniform(0, jitter))
            wait *= 2
    return None


def fetched(ids: DataFrame, key: str, fetch: Callable[[list[str]], list[dict]], out: T.StructType, size: int = 250, tasks: int = 8, done: DataFrame | None = None) -> DataFrame:
    """Rows that a batch function returns for ids: bounded parallelism, batches of ``size``, retries with backoff.

    ``fetch`` is a metadata service, a language model or any other client; it runs in the workers. Ids in ``done``, what an
    earlier run has stored, are not asked for again.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            todo = b[key].astype(str).tolist()
            for at in range(0, len(todo), size):
                part = todo[at : at + size]
                rows = with_backoff(lambda part=part: fetch(part))
                yield pd.DataFrame(rows, columns=[f.name for f in out])

    todo = ids.select(key) if done is None else ids.select(key).join(done.select(key), key, "left_anti")
    return todo.repartition(tasks, key).mapInPandas(run, out)


def indexed(spark: SparkSession, folder: str, source: DataFrame, columns: list[str], settings: dict, build: Callable[[], DataFrame]) -> DataFrame:
    """An index from a cache that is keyed by its content: a fingerprint of the source's columns and of all settings.

    Built and written where the folder has none for this content.
    """
    content = fingerprint(source, columns).first()["fingerprint"]
    key = hashlib.sha256(json.dumps([content, settings], sort_keys=True, default=str).encode()).hexdigest()[:16]
    return cached(spark, f"{folder}/{key}", ["index"], lambda: {"index": build()})["index"]


def missing_packages(names: list[str]) -> list[str]:
    """Those of the packages that cannot be imported here."""
    return [n for n in names if importlib.util.find_spec(n) is None]


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(value): the lines of text files."""
    return spark.read.text(path)


def path_filled(path: str) -> bool:
    """Whether a local output exists and is not empty."""
    return os.path.exists(path) and (os.path.getsize(path) > 0 if os.path.isfile(path) else any(os.scandir(path)))
