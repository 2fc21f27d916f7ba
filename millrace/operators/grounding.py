"""Grounding of answers: every citation must lie within one retrieved chunk of the same path."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.scalars import CITATION, valid_citations


def verify(answers: DataFrame, retrieved: DataFrame) -> DataFrame:
    """(query_id, answer, kept, dropped, valid) for answers (query_id, answer) and retrieved (query_id, path, start_line,
    end_line). Citations are deduplicated in order; an answer without citations is valid."""
    ranges = retrieved.groupBy("query_id").agg(F.collect_set(F.struct("path", "start_line", "end_line")).alias("ranges"))
    rows = answers.select("query_id", "answer", valid_citations(F.col("answer")).alias("cites")).join(ranges, "query_id", "left")
    none = F.array().cast("array<struct<path:string,start_line:bigint,end_line:bigint>>")
    r = F.coalesce(F.col("ranges").cast("array<struct<path:string,start_line:bigint,end_line:bigint>>"), none)
    inside = lambda c: F.exists(r, lambda x: (x.path == c.path) & (x.start_line <= c.lo) & (c.hi <= x.end_line))
    return rows.select(
        "query_id",
        "answer",
        F.filter("cites", inside).alias("kept"),
        F.filter("cites", lambda c: ~inside(c)).alias("dropped"),
    ).withColumn("valid", F.size("dropped") == 0)


_PATTERN = re.compile(CITATION)


def _strip(text: str | None, dropped) -> str | None:
    if text is None:
        return None
    gone = {(d["path"], d["lo"], d["hi"]) for d in (dropped if dropped is not None else ())}

    def one(m: re.Match) -> str:
        return "[citation removed]" if (m[2] or m[3], int(m[4]), int(m[5])) in gone else m[0]

    return _PATTERN.sub(one, text)


def strip_citations(df: DataFrame) -> DataFrame:
    """`df` with each citation of its column `dropped` replaced by a note in its column `answer`."""
    schema = df.schema
    at = schema.fieldNames().index("answer")

    def run(batches):
        for b in batches:
            new = pa.array([_strip(a, d) for a, d in zip(b.column("answer").to_pylist(), b.column("dropped").to_pylist())], pa.string())
            yield b.set_column(at, "answer", new)

    return df.mapInArrow(run, schema)


def settle(first: DataFrame, second: DataFrame, retrieved: DataFrame) -> DataFrame:
    """Final answers: a first answer that is valid stays, else the second attempt (query_id, answer) counts, stripped of what
    is still ungrounded; without a second attempt the first is stripped."""
    a = verify(first, retrieved)
    b = verify(second, retrieved).select("query_id", F.col("answer").alias("answer2"), F.col("kept").alias("kept2"), F.col("dropped").alias("dropped2"), F.col("valid").alias("valid2"))
    j = a.join(b, "query_id", "left")
    retry = ~F.col("valid") & F.col("answer2").isNotNull()
    text, gone = F.when(retry, F.col("answer2")).otherwise(F.col("answer")), F.when(retry, F.col("dropped2")).otherwise(F.col("dropped"))
    final = j.select("query_id", text.alias("answer"), gone.alias("dropped"), F.when(retry, F.col("kept2")).otherwise(F.col("kept")).alias("kept"), F.when(retry, F.col("valid2")).otherwise(F.col("valid")).alias("valid"), retry.alias("retried"))
    return strip_citations(final).drop("dropped")
