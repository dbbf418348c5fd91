"""Requests to a language model as columns: fields of a paper, prompts, and request lines of a batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def joined(values: Column) -> Column:
    """A list as one field, separated by semicolons; '' for none."""
    return F.array_join(F.coalesce(values, F.array().cast("array<string>")), ";")


def paper_fields(papers: DataFrame) -> DataFrame:
    """(id, title, abstract, affiliations, topics) as texts."""
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    return papers.select(
        "id", empty("title").alias("title"), empty("main_text").alias("abstract"), joined(F.col("organizations")).alias("affiliations"),
        joined(F.col("topics")).alias("topics"),
    )


def prompt(template: str, *columns: str) -> Column:
    """A template with {name} places for columns; other braces stay."""
    out: Column = F.lit(template)
    for c in columns:
        out = F.replace(out, F.lit("{" + c + "}"), F.coalesce(F.col(c).cast("string"), F.lit("")))
    return out


def request_lines(rows: DataFrame, key: str, body: Column, model: str, url: str = "/v1/responses") -> DataFrame:
    """(key, custom_id, value): a JSON request line for each row."""
    request = F.struct(
        F.col(key).alias("custom_id"), F.lit("POST").alias("method"), F.lit(url).alias("url"),
        F.struct(F.lit(model).alias("model"), body.alias("input")).alias("body"),
    )
    return rows.select(F.col(key), F.col(key).alias("custom_id"), F.to_json(request).alias("value"))
