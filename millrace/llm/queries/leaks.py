"""p8: evaluation items in documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.leakage import leaked_phrases, near_terms


def _tables(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")
    return docs, spark.read.parquet(f"{d}/eval_items.parquet").select("item_id", "text")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leaked_phrases(*_tables(spark, d)).select("item_id", "doc_id").distinct()


def p8_items(spark: SparkSession, d: str) -> DataFrame:
    """Per item that leaked: in how many documents, and its longest common phrase."""
    found = leaked_phrases(*_tables(spark, d))
    return found.groupBy("item_id").agg(F.countDistinct("doc_id").alias("n_docs"), F.max("n_words").alias("longest"))


def p8_proximity(spark: SparkSession, d: str) -> DataFrame:
    return near_terms(*_tables(spark, d))


QUERIES = {f.__name__: f for f in (p8_found, p8_items, p8_proximity)}

_WORDS = "regexp_extract_all(translate(lower(text), chr(8203) || chr(8205) || chr(65279), ''), '[\\p{L}\\p{Nd}]+')"
_GRAMS = f"""item_words AS (SELECT item_id, {_WORDS} AS w FROM eval_items), doc_words AS (SELECT doc_id, {_WORDS} AS w FROM documents),
  item_grams AS (SELECT DISTINCT item_id, list_aggregate(w[k:k + 19], 'string_agg', ' ') AS g FROM
    (SELECT item_id, w, unnest(range(1, len(w) - 18)) AS k FROM item_words)),
  doc_grams AS (SELECT DISTINCT doc_id, list_aggregate(w[k:k + 19], 'string_agg', ' ') AS g FROM
    (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS k FROM doc_words))"""

_PLACES = f"""item_words AS (SELECT item_id, {_WORDS} AS w FROM eval_items), doc_words AS (SELECT doc_id, {_WORDS} AS w FROM documents),
  item_at AS (SELECT item_id, k, list_aggregate(w[k:k + 19], 'string_agg', ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 18)) AS k FROM item_words)),
  doc_at AS (SELECT doc_id, k AS j, list_aggregate(w[k:k + 19], 'string_agg', ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS k FROM doc_words)),
  runs AS (SELECT item_id, doc_id, CAST(count(*) + 19 AS INTEGER) AS n_words FROM (SELECT item_id, doc_id, j - k AS shift, k - row_number() OVER (PARTITION BY item_id, doc_id, j - k ORDER BY k) AS island
    FROM item_at JOIN doc_at USING (g)) GROUP BY item_id, doc_id, shift, island)"""

SQL = {
    "p8_found": f"WITH {_GRAMS} SELECT DISTINCT item_id, doc_id FROM item_grams JOIN doc_grams USING (g)",
    "p8_items": f"WITH {_PLACES} SELECT item_id, count(DISTINCT doc_id) AS n_docs, max(n_words) AS longest FROM runs GROUP BY item_id",
}
