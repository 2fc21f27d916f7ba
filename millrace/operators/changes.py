"""Processing only new or changed records, each exactly once, whatever fails in between.

A feed lives in one folder of a shared file system, in five logs:

    log       segments of captured changes, each row with its log partition and its offset there
    state     the fingerprint known last of each key, up to some segment, so that old segments need not be read again
    plans     write-ahead plan of a batch: from and until offset of each partition of each segment
    sink      what a batch made of its rows, with key, segment, partition and offset
    commits   made last; a plan without a commit is replayed as it stands

An entry is written to a folder of its own and then published by creating the file that holds its number, which only one run
can do: a reader sees all of an entry or nothing, and of two runs that meet one stops. Plans cover each offset once, a batch
enters the sink once, and its rows enter by distinct key and offset, so a replay after a failure at any point repeats nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.session import claim, names_in, read_text, remove, small_rows

#: Index runs are counted in tens to thousands; more than this is refused rather than sent to every task.
MOST_RUNS = 20_000


def latest_by(df: DataFrame, keys: list[str], order: list[str], keep: list[str]) -> DataFrame:
    """One row per key: the greatest by `order`, ties by the values of `keep`. Null keys form a key of their own."""
    r = F.max(F.struct(*[F.col(c) for c in dict.fromkeys([*order, *keep])])).alias("r")
    return df.groupBy(*keys).agg(r).select(*keys, *[F.col(f"r.{c}").alias(c) for c in keep])


def trusted_state(log: DataFrame, runs: DataFrame, keys: list[str], fingerprint: str, at: str) -> DataFrame:
    """(keys, fingerprint): per key the latest row of `log` that a successful run wrote.

    A row belongs to the run with the greatest started_at not after its time; rows before the first run, rows without a
    fingerprint and rows of failed or aborted runs are not trusted.
    """
    found = small_rows(runs.where("started_at is not null").select("started_at", "run_id", "status"), "the table of runs", MOST_RUNS)
    last: dict[int, tuple] = {}
    for r in found:
        last[r.started_at] = max(last.get(r.started_at, (-1, "")), (r.run_id if r.run_id is not None else -1, r.status or ""))
    starts = sorted(last)
    # consecutive runs of like status form one span, so the test is a few comparisons
    spans, open_from = [], None
    for k, s in enumerate(starts):
        good = last[s][1] == "success"
        if good and open_from is None:
            open_from = s
        if not good and open_from is not None:
            spans.append((open_from, s))
            open_from = None
    if open_from is not None:
        spans.append((open_from, None))
    t, good = F.col(at), F.lit(False)
    if len(spans) <= 200:
        for a, b in spans:
            good = good | ((t >= a) & (t < b) if b is not None else t >= a)
    else:
        lits = F.array(*[F.struct(F.lit(a).cast("bigint").alias("a"), F.lit(b).cast("bigint").alias("b")) for a, b in spans])
        good = F.exists(lits, lambda s: (t >= s.a) & (s.b.isNull() | (t < s.b)))
    return latest_by(log.where(F.col(fingerprint).isNotNull() & good), keys, [at], [fingerprint])


class Overtaken(RuntimeError):
    """Another run has published the same entry."""


class ChangeFeed:
    """part_rows: rows of a segment's partition, which one task orders. compact_after: segments after which the state is written."""

    def __init__(self, spark: SparkSession, folder: str, keys: list[str], fingerprint: str, part_rows: int = 1_000_000, compact_after: int = 8):
        self.spark, self.folder, self.keys, self.fingerprint = spark, folder, keys, fingerprint
        self.part_rows, self.compact_after = part_rows, compact_after
        self._at: dict[tuple[str, int], str] = {}

    def _numbers(self, kind: str) -> list[int]:
        return sorted(int(n) for n in names_in(self.spark, f"{self.folder}/{kind}") if n.isdigit())

    def _publish(self, df: DataFrame, kind: str, number: int) -> None:
        data = f"{self.folder}/data/{kind}-{number}-{uuid.uuid4().hex}"
        df.write.parquet(data)
        if not claim(self.spark, f"{self.folder}/{kind}/{number}", data):
            remove(self.spark, data)
            raise Overtaken(f"{kind} {number} is there already")

    def _read(self, kind: str, numbers: list[int]) -> DataFrame | None:
        for n in numbers:
            if (kind, n) not in self._at:
                self._at[kind, n] = read_text(self.spark, f"{self.folder}/{kind}/{n}")
        paths = [self._at[kind, n] for n in numbers]
        return self.spark.read.parquet(*paths) if paths else None

    def _known(self, trusted: DataFrame | None = None) -> DataFrame | None:
        """(keys, fp, segment): the fingerprint known last of each key."""
        fp = F.lower(F.col(self.fingerprint).cast("string")).alias("fp")
        base = self._numbers("state")[-1:]
        parts = [] if trusted is None else [trusted.select(*self.keys, fp, F.lit(-1).cast("bigint").alias("segment"))]
        if base:
            parts.append(self._read("state", base).select(*self.keys, "fp", "segment"))
        newer = [n for n in self._numbers("log") if not base or n > base[0]]
        if newer:
            parts.append(self._read("log", newer).select(*self.keys, fp, "segment"))
        if not parts:
            return None
        rows = parts[0]
        for x in parts[1:]:
            rows = rows.unionByName(x)
        return latest_by(rows, self.keys, ["segment"], ["fp", "segment"])

    def capture(self, listing: DataFrame, trusted: DataFrame) -> int:
        """Appends to the log every key of `listing` whose fingerprint differs from the one known last: from the log itself,
        else from `trusted`. Upper and lower case of fingerprints are equal. Gives the segment's number."""
        fp = F.lower(F.col(self.fingerprint).cast("string")).alias("fp")
        known = self._known(trusted)
        known = known.select(*[F.col(k).alias(f"known_{k}") for k in self.keys], F.col("fp").alias("known_fp"), F.lit(True).alias("is_known"))
        on = F.lit(True)
        for k in self.keys:
            on = on & F.col(k).eqNullSafe(F.col(f"known_{k}"))
        now = listing.select(*self.keys, self.fingerprint, fp)
        new = now.join(known, on, "left").where(F.col("is_known").isNull() | ~F.col("fp").eqNullSafe(F.col("known_fp")))
        segment = max(self._numbers("log"), default=-1) + 1
        parts = max(1, -(-listing.count() // self.part_rows))
        new = new.select(*self.keys, self.fingerprint, F.lit(segment).cast("bigint").alias("segment"), F.pmod(F.xxhash64(*self.keys), F.lit(parts)).cast("int").alias("part"))
        order = Window.partitionBy("part").orderBy(*self.keys)
        self._publish(new.withColumn("offset", F.row_number().over(order).cast("bigint")), "log", segment)
        if segment - max(self._numbers("state"), default=-1) >= self.compact_after:
            self.compact()
        return segment

    def compact(self) -> None:
        """Writes the state up to the last segment."""
        segments = self._numbers("log")
        if segments and segments[-1] not in self._numbers("state"):
            self._publish(self._known(), "state", segments[-1])

    def plan(self) -> int | None:
        """The number of the batch to run: the one planned but not committed, else a new one over all segments that are in no
        earlier plan; None if there is nothing to do."""
        plans, commits = self._numbers("plans"), set(self._numbers("commits"))
        for b in plans:
            if b not in commits:
                return b
        done = self._read("plans", plans[-1:]).agg(F.max("segment")).first()[0] if plans else -1
        fresh = [n for n in self._numbers("log") if n > done]
        if not fresh:
            return None
        ranges = self._read("log", fresh).groupBy("segment", "part").agg((F.min("offset") - 1).alias("since"), F.max("offset").alias("until"))
        if not ranges.limit(1).count():
            return None
        number = max(plans, default=-1) + 1
        self._publish(ranges.coalesce(1), "plans", number)
        return number

    def rows(self, batch: int) -> DataFrame:
        """The log rows of a planned batch; the same for every replay."""
        plan = self._read("plans", [batch])
        segments = [r.segment for r in plan.select("segment").distinct().collect()]
        p = plan.select(F.col("segment").alias("p_segment"), F.col("part").alias("p_part"), "since", "until")
        log = self._read("log", segments)
        on = (F.col("segment") == F.col("p_segment")) & (F.col("part") == F.col("p_part")) & (F.col("offset") > F.col("since")) & (F.col("offset") <= F.col("until"))
        return log.join(F.broadcast(p), on, "left_semi")  # one row for part_rows rows of the log

    def run(self, process: Callable[[DataFrame], DataFrame] = lambda df: df, fail_after: str | None = None) -> int | None:
        """Plans, processes and commits one batch. `process` must keep the keys, segment, part and offset. `fail_after` (`plan`
        or `sink`) breaks off there, as a lost driver would."""
        batch = self.plan()
        if batch is None:
            return None
        if fail_after == "plan":
            raise RuntimeError("stopped after the plan")
        if batch not in self._numbers("sink"):
            self._publish(process(self.rows(batch)).dropDuplicates([*self.keys, "segment", "part", "offset"]), "sink", batch)
        if fail_after == "sink":
            raise RuntimeError("stopped after the sink")
        claim(self.spark, f"{self.folder}/commits/{batch}")
        return batch

    def processed(self) -> DataFrame | None:
        """All that the batches gave; no rows, in the columns of the log, if there was none; None before the first capture."""
        done = self._read("sink", self._numbers("sink"))
        if done is None and (segments := self._numbers("log")):
            return self._read("log", segments[:1]).limit(0)
        return done
