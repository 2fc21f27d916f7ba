"""References to records that do not exist.

References are counted per column, key and month first (partial aggregation on the map side makes one
hot key a handful of rows). Their distinct keys, each once whatever refers to it, are left anti-joined
against the parent keys; the keys that are left are joined back to the counts per table, column and month.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def live_keys(df: DataFrame, key: str, version: str, deleted: str) -> DataFrame:
    """Keys whose row with the greatest version is not deleted; among equal versions a live row wins."""
    r = F.struct(F.col(version).alias("v"), F.col(deleted).isNull().alias("alive"))
    return df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.max(r).alias("r")).where("r.alive").select("key")


def month_of(seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM")


def orphan_references(child: DataFrame, table_name: str, fk_columns: list[str], parents: list[DataFrame], at: str, ignore: Column | None = None) -> DataFrame:
    """(table_name, column_name, ref_key, ref_month, n_rows): the references of `fk_columns` without a target.

    parents: tables with a column `key`. ignore: a condition on `ref_key` for placeholders. Keys match exactly; null keys are
    no references; a null time gives a null month. Repeated rows count in n_rows only. Empty tables give no rows, or, as
    parents, make every reference an orphan. Other columns, whatever their names, are ignored.
    """
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("ref_key")) for c in fk_columns])).alias("r")
    refs = child.select(each, month_of(F.col(at)).alias("ref_month")).select("r.column_name", "r.ref_key", "ref_month").where("ref_key is not null")
    if ignore is not None:
        refs = refs.where(~ignore)
    refs = refs.groupBy("column_name", "ref_key", "ref_month").agg(F.count("*").alias("n_rows"))
    lost = refs.select(F.col("ref_key").alias("lost_key")).distinct()
    for p in parents:
        lost = lost.join(p.select(F.col("key").alias("parent_key")), F.col("lost_key") == F.col("parent_key"), "left_anti")
    refs = refs.join(lost, F.col("ref_key") == F.col("lost_key"), "left_semi")
    return refs.select(F.lit(table_name).alias("table_name"), "column_name", "ref_key", "ref_month", "n_rows")


def orphan_counts(orphans: DataFrame) -> DataFrame:
    """(table_name, column_name, ref_month, n_keys, n_rows) per table, column and month."""
    return orphans.groupBy("table_name", "column_name", "ref_month").agg(
        F.countDistinct("ref_key").alias("n_keys"), F.sum("n_rows").cast("bigint").alias("n_rows")
    )
