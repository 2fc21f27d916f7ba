"""Source files that do not parse, by the parsers of `syntax`."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.syntax import LANGUAGE, problems, suffix_of

_CHECKED = "repo string, path string, language string, accepted boolean, first_line int, first_cause string, n_errors int, errors array<struct<line:int,message:string>>"


def check_files(files: DataFrame) -> DataFrame:
    """`_CHECKED` for every row of files (repo, path, text) whose suffix is judged: accepted, the first error as the cause, and
    all errors.

    A null or empty text parses. Rows with a null path and other suffixes give no row; repeated rows are checked again.
    Nesting is limited as the languages do (Python 200 brackets and 100 indents, Go 100,000), JavaScript as Go.
    """

    def run(batches):
        for b in batches:
            out = []
            for repo, path, text in zip(*(b.column(c).to_pylist() for c in ("repo", "path", "text"))):
                got = problems(text or "", path) if path is not None else None
                if got is None:
                    continue
                first = got[0] if got else None
                out.append((repo, path, LANGUAGE[suffix_of(path)], not got, first and first.line, first and first.message, len(got), [{"line": p.line, "message": p.message} for p in got]))
            cols = list(zip(*out)) or [()] * 8
            types = [pa.string(), pa.string(), pa.string(), pa.bool_(), pa.int32(), pa.string(), pa.int32(), pa.list_(pa.struct([("line", pa.int32()), ("message", pa.string())]))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["repo", "path", "language", "accepted", "first_line", "first_cause", "n_errors", "errors"])

    return files.select("repo", "path", "text").mapInArrow(run, _CHECKED)


def clean_language(name):
    """A language name in one spelling; unknown and null names stay as they are, in lower case."""
    low = F.lower(F.trim(name))
    return F.when(low.isin("py", "python3"), "python").when(low.isin("js", "ecmascript"), "javascript").when(low.isin("ts"), "typescript").when(low.isin("golang"), "go").otherwise(low)


def rates(checked: DataFrame, languages: DataFrame | None = None) -> DataFrame:
    """(repo, language, n_files, n_failed, failed_share): by the language of the suffix, or, with `languages` (repo, path,
    language), by the language recorded there; files without one count under null."""
    rows = checked.select("repo", "path", "language", "accepted")
    if languages is not None:
        named = languages.where("language is not null").select(F.col("repo").alias("l_repo"), F.col("path").alias("l_path"), clean_language(F.col("language")).alias("named"))
        votes = named.groupBy("l_repo", "l_path", "named").count().groupBy("l_repo", "l_path").agg(F.max(F.struct("count", "named")).alias("r"))
        rows = rows.join(votes, rows.repo.eqNullSafe(votes.l_repo) & (rows.path == votes.l_path), "left").select("repo", F.col("r.named").alias("language"), "accepted")
    failed = F.sum((~F.col("accepted")).cast("bigint"))
    return rows.groupBy("repo", "language").agg(F.count("*").alias("n_files"), failed.alias("n_failed"), F.round(failed / F.count("*"), 6).alias("failed_share"))
