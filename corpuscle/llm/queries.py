"""Queries of the training-data problems, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.llm import canon, chunks, encode, names, neardup, truncated
from corpuscle.llm import mix as mixing
from corpuscle.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return canon.map_rows(table(spark, d, "typed_labels"), table(spark, d, "label_mapping"))


def p1_unmatched(spark: SparkSession, d: str) -> DataFrame:
    return canon.unmatched(table(spark, d, "typed_labels"), table(spark, d, "label_mapping"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.NearDuplicates(table(spark, d, "documents")).pairs()


def p3_groups(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return neardup.NearDuplicates(docs).groups().unionByName(neardup.short_groups(docs))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return names.variant_pairs(table(spark, d, "documents"), table(spark, d, "nickname_list"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return chunks.split_texts(table(spark, d, "documents")).where(F.col("piece_no") == 1).select("doc_id")


def p7_pieces(spark: SparkSession, d: str) -> DataFrame:
    return chunks.split_texts(table(spark, d, "documents"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode.encode_corpus(table(spark, d, "documents"))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.report(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return truncated.found(table(spark, d, "documents"))


def p10_shares(spark: SparkSession, d: str) -> DataFrame:
    return truncated.shares(table(spark, d, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_unmatched, p3_found, p3_groups, p4_found, p7_found, p7_pieces, p8_ids, p9_mix, p9_shares, p10_found, p10_shares)
}

SQL: dict[str, str] = {
    "p7_found": "SELECT doc_id FROM documents WHERE length(main_text) > 4000",
}
