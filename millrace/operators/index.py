"""Incremental index runs: scan, change set, extraction of what changed only, and tables that read as if built anew.

A run writes the rows of the files it took up, and one small table that tells for every live file which run wrote its rows. No
old row is rewritten: rows of changed and deleted files are dropped when a table is read, by a join with the live files, until
`compact` writes them together. Runs are published by creating one file, so that a run that breaks off leaves no trace.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import code
from millrace.operators.changes import Overtaken
from millrace.operators.tables import change_set
from millrace.session import claim, names_in, read_text, remove

FILE = ["repo", "path"]
#: Tables whose rows belong to one file each.
BY_FILE = ("parsed", "nodes", "references", "chunks")


class CodeIndex:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def runs(self) -> list[int]:
        return sorted(int(n) for n in names_in(self.spark, f"{self.folder}/runs") if n.isdigit())

    def _data(self, run: int) -> str:
        return read_text(self.spark, f"{self.folder}/runs/{run}")

    def live(self) -> DataFrame | None:
        """(repo, path, file_sha, status, run): the files of the last run, and the run that wrote their rows."""
        runs = self.runs()
        return self.spark.read.parquet(f"{self._data(runs[-1])}/live") if runs else None

    def _rows(self, table: str) -> DataFrame:
        """The rows of live files."""
        paths = [f"{self._data(n)}/{table}" for n in self.runs()]
        rows = self.spark.read.parquet(*paths)
        at = self.live().select(F.col("repo").alias("l_repo"), F.col("path").alias("l_path"), F.col("run").alias("l_run"))
        on = rows.repo.eqNullSafe(at.l_repo) & (F.col("path" if "path" in rows.columns else "src_path") == at.l_path) & (rows.run == at.l_run)
        return rows.join(at, on, "left_semi").drop("run")

    def nodes(self) -> DataFrame:
        return self._rows("nodes")

    def chunks(self) -> DataFrame:
        return self._rows("chunks")

    def edges(self) -> DataFrame:
        """References of all live files, and the definition edges of the whole table of symbols."""
        return code.weighed(self._rows("references").unionByName(code.definitions(self.nodes())))

    def run(self, files: DataFrame, force: bool = False, partial: bool = False) -> DataFrame:
        """Takes up files (repo, path, text, file_sha), one row a file, the tree as it is now, and gives the manifest: (repo,
        change, status, n_files, n_symbols, n_chunks), where change is added, modified, unchanged or deleted, and rows are
        counted for files that were read. Only added and modified files are read, with `force` all. A null fingerprint differs
        from all but null; rows with a null path are left out. With `partial` the files are those of some repositories only, and all
        others stay as they are."""
        files = files.where("path is not null")
        before = self.live()
        runs = self.runs()
        number = (runs[-1] + 1) if runs else 0
        base = f"{self.folder}/data/run-{number}-{uuid.uuid4().hex}"
        # a null repository is one of its own; joins by name would lose it
        key = lambda df: df.withColumn("r", F.coalesce(F.concat(F.lit("+"), "repo"), F.lit("-")))
        named = key(files).select("r").distinct()
        mine = key(before).join(named, "r", "left_semi") if before is not None and partial else before
        old = mine.select(*FILE, "file_sha") if before is not None else files.select(*FILE, "file_sha").limit(0)
        changes = change_set(key(old).select("r", "path", F.lower("file_sha").alias("file_sha")), key(files).select("r", "path", F.lower("file_sha").alias("file_sha")), ["r", "path"], "file_sha")
        changes.write.parquet(f"{base}/changes")
        changes = self.spark.read.parquet(f"{base}/changes").withColumn("repo", F.when(F.col("r") != "-", F.substring("r", 2, 1 << 30)))
        take = changes if force else changes.where("change in ('added', 'modified')")
        take = take.where("change <> 'deleted'").select("r", F.col("path").alias("t_path"))
        k = key(files)
        fresh = k.join(take, (k.r == take.r) & (k.path == take.t_path), "left_semi").drop("r")
        run = F.lit(number).alias("run")
        code.parse_python(fresh.select(*FILE, "text")).withColumn("run", run).write.parquet(f"{base}/parsed")
        parsed = self.spark.read.parquet(f"{base}/parsed")
        code.nodes_of(parsed).withColumn("run", run).write.parquet(f"{base}/nodes")
        code.references(parsed).withColumn("run", run).write.parquet(f"{base}/references")
        code.chunks_of(parsed).withColumn("run", run).write.parquet(f"{base}/chunks")
        # files without a language have no row in parsed, yet are known
        now = fresh.select(*FILE, "file_sha")
        st = parsed.select(F.col("repo").alias("p_repo"), F.col("path").alias("p_path"), "status")
        live = now.join(st, now.repo.eqNullSafe(st.p_repo) & (now.path == st.p_path), "left").select(*FILE, "file_sha", "status", run)
        if before is not None and not force:
            kept = changes.where("change = 'unchanged'").select("r", F.col("path").alias("t_path"))
            b = key(before)
            live = live.unionByName(b.join(kept, (b.r == kept.r) & (b.path == kept.t_path), "left_semi").drop("r"))
        if before is not None and partial:
            live = live.unionByName(key(before).join(named, "r", "left_anti").drop("r"))
        live.write.parquet(f"{base}/live")
        if not claim(self.spark, f"{self.folder}/runs/{number}", base):
            remove(self.spark, base)
            raise Overtaken(f"run {number} is there already")
        return self._manifest(changes.select("repo", "path", "change"), parsed)

    def _manifest(self, changes: DataFrame, parsed: DataFrame) -> DataFrame:
        p = parsed.select(F.col("repo").alias("p_repo"), F.col("path").alias("p_path"), "status", F.size("defs").alias("n_symbols"), F.size("chunks").alias("n_chunks"))
        m = changes.join(p, changes.repo.eqNullSafe(p.p_repo) & (changes.path == p.p_path), "left")
        status = F.when(F.col("change") == "deleted", None).when(F.col("p_path").isNotNull(), F.col("status")).when(F.col("change") == "unchanged", "cached").otherwise("no language")
        count = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
        return m.groupBy("repo", "change", status.alias("status")).agg(F.count("*").alias("n_files"), count("n_symbols"), count("n_chunks"))

    def compact(self) -> None:
        """One run that holds the rows of all live files; older runs are not read again."""
        runs = self.runs()
        if len(runs) < 2:
            return
        number = runs[-1] + 1
        base = f"{self.folder}/data/run-{number}-{uuid.uuid4().hex}"
        for t in BY_FILE:
            self._rows(t).withColumn("run", F.lit(number)).write.parquet(f"{base}/{t}")
        self.live().withColumn("run", F.lit(number)).write.parquet(f"{base}/live")
        if not claim(self.spark, f"{self.folder}/runs/{number}", base):
            remove(self.spark, base)
            raise Overtaken(f"run {number} is there already")
        for n in runs:
            data = self._data(n)
            remove(self.spark, f"{self.folder}/runs/{n}")
            remove(self.spark, data)
