"""Queries p3, p6 and p10 over whole tables. SQL cannot express their texts' forms; tests compare them with brute force."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from maldadum.llm import confusables, overlap, quality
from maldadum.sources.tables import table


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    values = confusables.record_values(table(spark, folder, "corpus_records"))
    return confusables.stand_ins(values, "value", "rec_no", "field", "err_pos")


def p3_forms(spark: SparkSession, folder: str) -> DataFrame:
    """Every text in its consistent form; those of plain characters only are their form and stay in the JVM."""
    values = confusables.record_values(table(spark, folder, "corpus_records"))
    odd = F.coalesce(confusables.suspicious(F.col("value")), F.lit(False))
    changed = confusables.normalized(values.where(odd), "value", "rec_no", "field", "err_pos").select("rec_no", "field", "err_pos", "form")
    return changed.unionByName(values.where(~odd).select("rec_no", "field", "err_pos", F.col("value").alias("form")))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    pairs = overlap.cross_split_pairs(table(spark, folder, "edit_tagger_v2_dataset"))
    return pairs.select(F.col("key_a").alias("ex_a"), F.col("key_b").alias("ex_b")).distinct()


def p6_report(spark: SparkSession, folder: str) -> DataFrame:
    return overlap.split_report(table(spark, folder, "edit_tagger_v2_dataset"))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    kinds = quality.document_statistics(table(spark, folder, "documents"), "doc_id", "text")
    return kinds.where("doc_kind is not null").select("doc_id", "doc_kind")


def p10_statistics(spark: SparkSession, folder: str) -> DataFrame:
    return quality.document_statistics(table(spark, folder, "documents"), "doc_id", "text")


QUERIES = {f.__name__: f for f in (p3_found, p3_forms, p6_found, p6_report, p10_found, p10_statistics)}
SQL: dict[str, str] = {}
