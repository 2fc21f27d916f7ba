"""p10: subject areas of documents and the composition of the corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.subjects import document_subjects


def _subjects(spark: SparkSession, d: str) -> DataFrame:
    docs, labels, areas = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "subject_labels", "subject_areas"))
    return document_subjects(docs, labels, areas)


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return _subjects(spark, d).select("doc_id", "subject")


def p10_composition(spark: SparkSession, d: str) -> DataFrame:
    """Documents per subject, and their share of all rows; a document of two subjects counts for both."""
    n = _subjects(spark, d).groupBy("subject").agg(F.count("*").alias("n_docs"), F.round(F.avg("part"), 4).alias("mean_part"))
    return n


def p10_documents(spark: SparkSession, d: str) -> DataFrame:
    """Every document that is not blank has subjects, software alone or some of the others."""
    s = _subjects(spark, d).groupBy("doc_id").agg(F.count("*").alias("n"), F.countDistinct("subject").alias("k"), F.max(F.col("subject") == "software").alias("rest"))
    return s.select("doc_id", ((F.col("n") == F.col("k")) & (~F.col("rest") | (F.col("n") == 1))).alias("sound"))


QUERIES = {f.__name__: f for f in (p10_found, p10_composition, p10_documents)}
SQL = {"p10_documents": "SELECT doc_id, true AS sound FROM documents WHERE regexp_matches(text, '\\S')"}
