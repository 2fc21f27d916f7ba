"""p5: source files that do not parse."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.unparsed import check_files, rates


def _listed(spark: SparkSession, d: str) -> DataFrame:
    """The counting row of each file: the greatest seen_at."""
    rows = spark.read.parquet(f"{d}/source_files.parquet")
    last = rows.groupBy("repo", "path").agg(F.max(F.struct("seen_at", "file_sha", "text")).alias("r"))
    return last.select("repo", "path", F.col("r.text").alias("text"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return check_files(_listed(spark, d)).where("not accepted").select("repo", "path")


def p5_errors(spark: SparkSession, d: str) -> DataFrame:
    """Each failed file with its first cause and the number of its errors."""
    return check_files(_listed(spark, d)).where("not accepted").select("repo", "path", "language", "first_line", "first_cause", "n_errors")


def p5_rates(spark: SparkSession, d: str) -> DataFrame:
    return rates(check_files(_listed(spark, d)))


def p5_node_rates(spark: SparkSession, d: str) -> DataFrame:
    return rates(check_files(_listed(spark, d)), spark.read.parquet(f"{d}/nodes.parquet").select("repo", "path", "language"))


def p5_stale_status(spark: SparkSession, d: str) -> DataFrame:
    """How often the status recorded last in file_meta agrees with the parsers."""
    meta = spark.read.parquet(f"{d}/file_meta.parquet")
    last = meta.groupBy("repo", "path").agg(F.max(F.struct("last_indexed_at", "parse_status")).alias("r"))
    last = last.select(F.col("repo").alias("m_repo"), F.col("path").alias("m_path"), F.col("r.parse_status").alias("parse_status"))
    files = check_files(_listed(spark, d))
    both = files.join(last, files.repo.eqNullSafe(last.m_repo) & (files.path == last.m_path), "left")
    return both.groupBy("parse_status", "accepted").agg(F.count("*").alias("n_files"))


QUERIES = {f.__name__: f for f in (p5_found, p5_errors, p5_rates, p5_node_rates, p5_stale_status)}
SQL: dict[str, str] = {}
