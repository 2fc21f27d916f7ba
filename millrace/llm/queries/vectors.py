"""p4: near neighbours of chunk and community vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.neighbours import Params, exact_nearest, nearest, usable_vectors

MODEL, DIM = "codevec-64", 64


def _rows(spark: SparkSession, d: str) -> DataFrame:
    chunk = usable_vectors(spark.read.parquet(f"{d}/chunk_embeddings.parquet"), "chunk_id", "vector", "created_at", MODEL, DIM)
    community = usable_vectors(spark.read.parquet(f"{d}/community_embeddings.parquet"), "community_id", "vector", "created_at", MODEL, DIM)
    return chunk.withColumn("ns", F.lit("chunk")).unionByName(community.withColumn("ns", F.lit("community")))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    near = nearest(_rows(spark, d), Params(min_cosine=0.85))
    pairs = near.select(F.col("ns").alias("vec_set"), F.least("key", "neighbour").alias("key_a"), F.greatest("key", "neighbour").alias("key_b"))
    return pairs.distinct()


def p4_neighbours(spark: SparkSession, d: str) -> DataFrame:
    near = nearest(_rows(spark, d))
    return near.select(F.col("ns").alias("vec_set"), "key", "neighbour", "rank", F.round("cosine", 6).alias("cosine"))


def _asked(rows: DataFrame) -> DataFrame:
    """The stated query set: every fiftieth community by id, and every fiftieth chunk by a digest of its id."""
    return rows.where("case when ns = 'community' then pmod(cast(key as bigint), 50) = 0 else pmod(cast(conv(left(md5(key), 8), 16, 10) as bigint), 50) = 0 end")


def p4_exact(spark: SparkSession, d: str) -> DataFrame:
    """The five nearest of the stated query set by comparison with all rows."""
    rows = _rows(spark, d)
    return exact_nearest(rows, _asked(rows), 5).select(F.col("ns").alias("vec_set"), "key", "neighbour", "rank")


def p4_recall(spark: SparkSession, d: str) -> DataFrame:
    """Recall of the five nearest for the stated query set, per vector set, against brute force over all rows."""
    rows = _rows(spark, d)
    truth = exact_nearest(rows, _asked(rows), 5)
    got = nearest(rows).select("ns", "key", "neighbour", F.lit(1).alias("hit"))
    joined = truth.join(got, ["ns", "key", "neighbour"], "left")
    return joined.groupBy(F.col("ns").alias("vec_set")).agg(F.count("*").alias("n_true"), F.round(F.avg(F.coalesce("hit", F.lit(0))), 4).alias("recall"))


QUERIES = {f.__name__: f for f in (p4_found, p4_neighbours, p4_exact, p4_recall)}

_USABLE = """
select '{ns}' as vec_set, key, list_transform(r.vec, lambda x: x / sqrt(list_sum(list_transform(r.vec, lambda y: y * y)))) as vec from (
  select key, max({{'since': since, 'vec': vec}}) as r from (
    select cast({key} as varchar) as key, created_at as since, list_transform(vector, lambda x: cast(x as double)) as vec from {table}
    where {key} is not null and model = 'codevec-64' and len(vector) = 64 and len(list_filter(vector, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(vector, lambda x: x <> 0)) > 0
  ) group by key
)"""

#: The approximate search has no equal in SQL; its recall is measured by p4_recall and in tests/llm.
SQL: dict[str, str] = {
    "p4_exact": f"""
with v as ({_USABLE.format(ns="chunk", key="chunk_id", table="chunk_embeddings")} union all {_USABLE.format(ns="community", key="community_id", table="community_embeddings")}),
q as (select * from v where case when vec_set = 'community' then cast(key as bigint) % 50 = 0 else cast('0x' || left(md5(key), 8) as bigint) % 50 = 0 end),
s as (select q.vec_set, q.key, v.key as neighbour, row_number() over (partition by q.vec_set, q.key order by round(list_dot_product(q.vec, v.vec), 12) desc, v.key) as rank from q join v on v.vec_set = q.vec_set and v.key <> q.key)
select vec_set, key, neighbour, cast(rank as int) as rank from s where rank <= 5""",
}
