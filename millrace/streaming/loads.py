"""Streams that feed stored indexes, each micro-batch once: vectors in flushes, and listings of repositories to index again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.changes import latest_by
from millrace.operators.index import CodeIndex
from millrace.operators.vector import VectorIndex
from millrace.session import claim, exists

VECTORS = "item bigint, vector array<float>"
LISTING = "repo string, path string, text string, file_sha string, seen_at bigint"


def _once(spark: SparkSession, mark: str, work) -> None:
    """Runs `work` unless it is marked as done. What a batch that broke off had written is written again, and equals it."""
    if not exists(spark, mark):
        work()
        claim(spark, mark)


def bulk_load(spark: SparkSession, folder: str, index: VectorIndex, checkpoint: str, files_per_flush: int = 10):
    """A query that adds the vectors of JSON files in `folder` to an index, a flush of files at a time. In a flush the last row of
    an item counts by no order but its vector; a vector of a wrong length stops the stream before its flush is added."""
    rows = spark.readStream.schema(VECTORS).option("maxFilesPerTrigger", files_per_flush).json(folder)

    def flush(batch: DataFrame, number: int) -> None:
        one = batch.where("item is not null and vector is not null").groupBy("item").agg(F.max("vector").alias("vector"))
        _once(spark, f"{index.folder}/flushes/{number}", lambda: index.add(one))

    return rows.writeStream.foreachBatch(flush).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def reindex(spark: SparkSession, folder: str, index: CodeIndex, checkpoint: str, files_per_batch: int = 100):
    """A query that takes up listings, JSON files of all files of some repositories: their changed files are read, those not
    listed any more go, and other repositories stay. Of a file listed more than once the greatest seen_at counts."""
    rows = spark.readStream.schema(LISTING).option("maxFilesPerTrigger", files_per_batch).json(folder)

    def take(batch: DataFrame, number: int) -> None:
        files = latest_by(batch.where("path is not null"), ["repo", "path"], ["seen_at"], ["file_sha", "text"])
        _once(spark, f"{index.folder}/batches/{number}", lambda: index.run(files, partial=True))

    return rows.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
