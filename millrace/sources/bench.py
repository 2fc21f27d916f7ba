"""Files of evaluations: questions as JSON lines, benchmark rows as CSV, and sets of vectors with their true neighbours."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.vector import top_k
from millrace.sources.vecs import FvecsSource, IvecsSource

QUESTIONS = (
    "id string, repo string, question string, symbol string, expected array<string>, reference_answer string, expected_paths array<string>, "
    "expected_citations array<struct<path:string,lines:array<bigint>>>, bucket string, language string"
)
#: Columns of a benchmark's rows, in order, and those that hold whole numbers (fixed values).
BENCH_COLUMNS = "index M efC efSearch recall qps p50_ms p99_ms build_s rss_mb recover_p50_ms n dim".split()
BENCH_WHOLE = frozenset("M efC efSearch n dim".split())
#: Names under which the parts of a set of vectors are looked for, in order (fixed values).
PARTS = {"base": ("sift_base.fvecs", "base.fvecs", "sift/sift_base.fvecs"), "query": ("sift_query.fvecs", "query.fvecs", "sift/sift_query.fvecs"), "truth": ("sift_groundtruth.ivecs", "groundtruth.ivecs", "sift/sift_groundtruth.ivecs")}


def load_questions(spark: SparkSession, path: str, schema: str = QUESTIONS) -> DataFrame:
    """Questions, one JSON object a line; blank lines are skipped, a line that is no JSON gives a row of nulls."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(F.from_json("value", schema).alias("q")).select("q.*")


def read_bench(spark: SparkSession, path: str) -> DataFrame:
    """`BENCH_COLUMNS` of a CSV with a header, in any order; missing and empty numbers are 0, rows without an index are skipped."""
    raw = spark.read.option("header", True).csv(path)

    def column(c: str):
        text = F.col(f"`{c}`") if c in raw.columns else F.lit(None).cast("string")
        if c == "index":
            return text.alias(c)
        number = F.coalesce(text.cast("double"), F.lit(0.0))
        return (number.cast("bigint") if c in BENCH_WHOLE else number).alias(c)

    rows = raw.select(*[column(c) for c in BENCH_COLUMNS])
    return rows.where(F.coalesce("index", F.lit("")) != "")


def write_bench(rows: DataFrame, path: str) -> None:
    """Appends rows to a folder of CSV files with headers; columns that rows lack are 0."""
    out = [F.col(c) if c in rows.columns else F.lit(0).alias(c) for c in BENCH_COLUMNS]
    rows.select(*out).write.mode("append").option("header", True).csv(path)


def load_sift(spark: SparkSession, folder: str, max_base: int | None = None, max_queries: int | None = None, k: int = 100) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(base (item, vector), queries (query_id, vector), truth (query_id, item, rank)). The truth is that of the files, or, if the
    base is cut to `max_base`, computed again for it. A missing or empty part is an error."""
    spark.dataSource.register(FvecsSource)
    spark.dataSource.register(IvecsSource)

    def part(kind: str, form: str, most: int | None) -> DataFrame:
        found = [p for n in PARTS[kind] if os.path.exists(p := f"{folder}/{n}")]
        if not found:
            raise FileNotFoundError(f"no {kind} in {folder}")
        read = spark.read.format(form).option("path", found[0])
        return (read.option("max", str(most)) if most else read).load()

    base = part("base", "fvecs", max_base).select(F.col("position").alias("item"), "vector")
    queries = part("query", "fvecs", max_queries).select(F.col("position").alias("query_id"), "vector")
    if not base.limit(1).count() or not queries.limit(1).count():
        raise ValueError(f"an empty part in {folder}")
    if max_base:
        return base, queries, top_k(queries, base, k, "l2").select("query_id", "item", "rank")
    truth = part("truth", "ivecs", max_queries)
    return base, queries, truth.select(F.col("position").alias("query_id"), F.posexplode("vector").alias("at", "item")).where(F.col("at") < k).select("query_id", F.col("item").cast("bigint").alias("item"), (F.col("at") + 1).alias("rank"))
