"""p6: generated, minified, vendored and data files among the chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.provenance import LABELS, label_files


def _labels(spark: SparkSession, d: str) -> DataFrame:
    return label_files(spark.read.parquet(f"{d}/chunks.parquet"), spark.read.parquet(f"{d}/upstream_files.parquet"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _labels(spark, d).where("label <> 'handwritten'").select("repo", "path")


def p6_labels(spark: SparkSession, d: str) -> DataFrame:
    return _labels(spark, d).groupBy("repo", "label").agg(F.count("*").alias("n_files"))


def p6_files(spark: SparkSession, d: str) -> DataFrame:
    """Every file has one label: files per repository by their labels."""
    return _labels(spark, d).groupBy("repo").agg(F.count("*").alias("n_files"), F.sum(F.col("label").isin(*LABELS).cast("bigint")).alias("n_labelled"))


QUERIES = {f.__name__: f for f in (p6_found, p6_labels, p6_files)}
SQL = {"p6_files": "SELECT repo, count(*) AS n_files, count(*) AS n_labelled FROM (SELECT DISTINCT repo, path FROM chunks WHERE path IS NOT NULL) GROUP BY repo"}
