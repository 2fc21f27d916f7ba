"""A file listing as a data source, since Spark's own sources skip names that begin with a dot or an underscore."""

from __future__ import annotations

from collections.abc import Iterator

from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from millrace.functions.scalars import language_of

#: Directories that never hold a project's own source (fixed values); other directories that begin with a dot are skipped as well.
SKIPPED = frozenset(".git .hg .svn node_modules venv .venv env .env __pycache__ .tox .nox dist build .mypy_cache .ruff_cache .pytest_cache .cache .idea .vscode".split())
MAX_BYTES = 1_000_000
#: Directories up to which the driver lists, so that there is something to share out; tasks list all that is below them.
SPREAD = 256


class _Part(InputPartition):
    def __init__(self, files: list[str], folder: str | None = None):
        self.files, self.folder = files, folder


class _Reader(DataSourceReader):
    def __init__(self, root: str, per_task: int, skipped: frozenset[str]):
        self.root, self.per_task, self.skipped = root, per_task, skipped

    def _open(self) -> tuple[arrow_fs.FileSystem, str]:
        """The file system of the root, on this machine or any that an address names, and the root's path in it."""
        if "://" in self.root:
            return arrow_fs.FileSystem.from_uri(self.root.rstrip("/"))
        return arrow_fs.LocalFileSystem(), self.root.rstrip("/") or "/"

    def _list(self, fs: arrow_fs.FileSystem, folder: str) -> tuple[list, list[str]]:
        """Files and directories to go on with, in order of their names; none for a directory that cannot be read."""
        try:
            found = sorted(fs.get_file_info(arrow_fs.FileSelector(folder, allow_not_found=True)), key=lambda x: x.path)
        except OSError:
            return [], []
        dirs = [x.path for x in found if x.type == arrow_fs.FileType.Directory and x.base_name not in self.skipped and not x.base_name.startswith(".")]
        return [x for x in found if x.type == arrow_fs.FileType.File], dirs

    def partitions(self) -> list[InputPartition]:
        fs, root = self._open()
        parts, todo = [], [root]
        while todo and len(todo) + len(parts) < SPREAD:
            files, dirs = self._list(fs, todo.pop(0))
            todo += dirs
            names = [x.path for x in files]
            parts += [_Part(names[i : i + self.per_task]) for i in range(0, len(names), self.per_task)]
        return parts + [_Part([], d) for d in todo] or [_Part([])]

    def _below(self, fs: arrow_fs.FileSystem, folder: str) -> Iterator:
        todo = [folder]
        while todo:
            files, dirs = self._list(fs, todo.pop())
            yield from files
            todo += dirs

    def read(self, part: _Part) -> Iterator[tuple]:
        fs, root = self._open()
        listed = self._below(fs, part.folder) if part.folder else fs.get_file_info(part.files) if part.files else []
        for x in listed:
            data, error = None, None
            try:
                with fs.open_input_stream(x.path) as f:
                    data = f.read()
            except OSError as e:
                error = type(e).__name__
            yield x.path[len(root) :].lstrip("/"), int(x.mtime.timestamp()) if x.mtime else None, data, error


class SourceTree(DataSource):
    """Options: path, per_task (files a task reads). Columns: path relative to the root, mtime, content, error. A file that
    cannot be read comes with a null content and the kind of its error."""

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return "path string, mtime bigint, content binary, error string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], int(self.options.get("per_task", "500")), SKIPPED)


def read_tree(spark: SparkSession, root: str) -> DataFrame:
    """(path, mtime, content, error, file_sha, language) of every file under root; dot-directories and `SKIPPED` apart."""
    spark.dataSource.register(SourceTree)
    t = spark.read.format("source_tree").option("path", root).load()
    return t.withColumn("file_sha", F.sha1("content")).withColumn("language", language_of(F.col("path")))
