"""All queries of the core, by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpuscle.plans import pipeline, pipeline_sql, problems, reference, reference_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**reference.QUERIES, **pipeline.QUERIES, **problems.QUERIES}
SQL: dict[str, str] = {**reference_sql.SQL, **pipeline_sql.SQL, **problems.SQL}
