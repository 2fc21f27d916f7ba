"""Writes and deletes as DataFrame transformations on immutable tables: upserts, cascades, change sets, checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """`old` with the rows of `new` in place of those of equal key; among rows of `new`, the greatest `order` wins."""
    cols = [c for c in old.columns]
    both = old.select(*cols, F.lit(0).alias("_new")).unionByName(new.select(*cols, F.lit(1).alias("_new")))
    # the order first, then all columns, so that repeated rows and ties give one row
    r = F.struct(F.col("_new"), F.col(order).alias("_o"), *[F.col(c) for c in cols if c not in keys])
    kept = both.groupBy(*keys).agg(F.max(r).alias("_r"))
    return kept.select(*[F.col(c) if c in keys else F.col(f"_r.{c}").alias(c) for c in cols])


def upsert_edges(old: DataFrame, new: DataFrame) -> DataFrame:
    """Edges by (src, dst, kind, src_line): weights add up, the path of the earliest row stays."""
    cols = ["src", "dst", "kind", "src_path", "src_line", "weight", "indexed_at"]
    both = old.select(*cols).unionByName(new.select(*cols))
    return both.groupBy("src", "dst", "kind", "src_line").agg(
        F.sum(F.coalesce("weight", F.lit(1))).cast("bigint").alias("weight"), F.min_by("src_path", F.struct("indexed_at", "src_path")).alias("src_path")
    )


def delete_where(table: DataFrame, doomed: DataFrame, keys: list[str]) -> DataFrame:
    return table.join(doomed.select(*keys).distinct(), keys, "left_anti")


def cascade(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """The rows of `child` whose parent is still there."""
    return child.join(parent.select(key).distinct(), key, "left_semi")


def change_set(old: DataFrame, new: DataFrame, keys: list[str], fingerprint: str) -> DataFrame:
    """(keys, change): added, modified, deleted or unchanged."""
    o = old.select(*keys, F.col(fingerprint).alias("o_fp"), F.lit(True).alias("o_there"))
    n = new.select(*keys, F.col(fingerprint).alias("n_fp"), F.lit(True).alias("n_there"))
    change = (
        F.when(F.col("o_there").isNull(), "added").when(F.col("n_there").isNull(), "deleted").when(F.col("o_fp").eqNullSafe(F.col("n_fp")), "unchanged").otherwise("modified")
    )
    return o.join(n, keys, "full_outer").select(*keys, change.alias("change"))


def require_dim(df: DataFrame, vector: str, dim: str | int) -> DataFrame:
    """`df`, or an error while it runs if a vector has another length than `dim`."""
    want: Column = F.col(dim) if isinstance(dim, str) else F.lit(dim)
    bad = F.raise_error(F.concat(F.lit("vector of length "), F.size(vector).cast("string"), F.lit(" where "), want.cast("string"), F.lit(" is needed")))
    return df.withColumn(vector, F.when(F.col(vector).isNull() | (F.size(vector) == want), F.col(vector)).otherwise(bad))


def model_stats(vectors: DataFrame) -> DataFrame:
    """(model, n, max_dim, min_dim, mixed) per model."""
    g = vectors.groupBy("model").agg(F.count("*").alias("n"), F.max("dim").alias("max_dim"), F.min("dim").alias("min_dim"))
    return g.withColumn("mixed", F.col("max_dim") != F.col("min_dim"))


def level_counts(communities: DataFrame) -> DataFrame:
    """(level, n) with a row of a null level for the total; levels that are null themselves count in the total only."""
    return communities.where("level is not null").rollup("level").agg(F.count("*").alias("n"))


def summary_cache(now: DataFrame, before: DataFrame, placeholder: str = "<auto-summary unavailable>") -> DataFrame:
    """`now` (community_id, content_sha) with the title and summary of the latest community of equal content that has a real one."""
    real = before.where((F.coalesce("summary", F.lit("")) != "") & (F.col("summary") != placeholder))
    last = real.groupBy(F.col("content_sha").alias("b_sha")).agg(F.max(F.struct("detected_at", "title", "summary")).alias("r"))
    return now.join(last, F.col("content_sha") == F.col("b_sha"), "left").select("community_id", "content_sha", F.col("r.title").alias("title"), F.col("r.summary").alias("summary"), F.col("r.summary").isNotNull().alias("from_cache"))
