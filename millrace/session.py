"""Session settings, the shared folder, and the one place where tables are written to cut lineage."""

from __future__ import annotations

import re
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

#: Rows a table may have at most to be sent to every executor. Checked by `small_rows`.
BROADCAST_ROWS = 200_000

_own_dir: dict[str, str] = {}
_roots: set[str] = set()


def build_session(app: str = "millrace", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the plans expect (UTC, adaptive execution, Arrow batches)."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. A folder of our own stands in for it only where all tasks run in this process,
    as in tests; a cluster without the setting is an error, as no folder of one machine is seen by the others."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(?:\[[^\]]*\])?", sc.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if sc.applicationId not in _own_dir:
        _own_dir[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="millrace-")
        fs, p = _fs(spark, _own_dir[sc.applicationId])
        fs.deleteOnExit(p)
        sc.setCheckpointDir(_own_dir[sc.applicationId])
    return _own_dir[sc.applicationId]


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder; what is written there is removed when the driver ends."""
    root = f"{shared_dir(spark)}/millrace/{spark.sparkContext.applicationId}"
    if root not in _roots:
        fs, p = _fs(spark, root)
        fs.mkdirs(p)
        fs.deleteOnExit(p)  # of what is there already
        _roots.add(root)
    return f"{root}/{name}-{uuid.uuid4().hex}"


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def claim(spark: SparkSession, path: str, text: str = "") -> bool:
    """Creates a small file that nobody has created before; False if it is there. File systems do this in one step, object
    stores too, which know no rename of folders."""
    fs, p = _fs(spark, path)
    try:
        out = fs.create(p, False)
    except Py4JJavaError as e:
        if fs.exists(p):
            return False
        raise OSError(f"could not create {path}") from e
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    return True


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = _fs(spark, path)
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def names_in(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder, none if it is not there."""
    fs, p = _fs(spark, path)
    return [x.getPath().getName() for x in fs.listStatus(p)] if fs.exists(p) else []


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` written to the shared folder and read back: lineage ends there, and a lost executor costs no recomputation."""
    return written_at(df, fresh_path(df.sparkSession, name))


def written_at(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_rows(df: DataFrame, what: str, most: int = BROADCAST_ROWS) -> list:
    """The rows of a table that has a stated bound; more rows than the bound are an error, never cut off."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{what} has more than {most} rows and may not be sent to the driver")
    return rows
