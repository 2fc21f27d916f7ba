"""p7: credentials in chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.secrets import detect


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/chunks.parquet").select("chunk_id", "path", "text")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return detect(_chunks(spark, d))[0].select("chunk_id", "line_no")


def p7_redacted(spark: SparkSession, d: str) -> DataFrame:
    return detect(_chunks(spark, d))[1]


def p7_rules(spark: SparkSession, d: str) -> DataFrame:
    return detect(_chunks(spark, d))[0].groupBy("rule").agg(F.count("*").alias("n_places"), F.countDistinct("chunk_id").alias("n_chunks"))


QUERIES = {f.__name__: f for f in (p7_found, p7_redacted, p7_rules)}
SQL: dict[str, str] = {}
