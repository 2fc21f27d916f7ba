"""Mixing sources to target shares of the total size.

1. Sizes in tokens are counted for every record; records become blocks: bounded runs of one source's records in hash order.
2. The total is the largest for which every source can meet its quota within its cap of repeats ("fit"), or is given; quotas
   that a source cannot meet are cut to what it has and reported.
3. A quota is whole passes over the source plus a random part of its blocks, so no record comes more than once more often
   than another and none more than `max_repeats` times.
4. A splitting tree deals the blocks to the output shards: at each node the blocks of every source are split between the two
   halves by a multivariate hypergeometric draw, so each shard gets an exact random quota of each source. Draws depend on
   (seed, node) alone, and cost is one row per source and node, not per record.
5. Each shard takes its disjoint runs of the permuted blocks and is shuffled locally, by a hash of seed, record and pass.
"""

from __future__ import annotations

import base64
import math
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.session import small_rows, written

MOST_SOURCES = 10_000


def token_counts(docs: DataFrame, text: str, vocabulary: str, pattern: str) -> DataFrame:
    """`docs` with a column n_tokens, by a byte-level BPE of a public vocabulary file; null texts count none."""

    def count(batches):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(vocabulary).read_bytes().splitlines())}
        enc = tiktoken.Encoding("public", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        for s in batches:
            yield pd.Series([len(enc.encode_ordinary(t)) if t is not None else 0 for t in s], dtype="int64")

    def run(it):
        yield from count(it)

    from collections.abc import Iterator

    run.__annotations__ = {"it": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return docs.withColumn("n_tokens", F.pandas_udf(run, "bigint")(F.col(text)))


def clean_source(c):
    """One spelling for sources: trimmed, lower case, hyphens and blanks as underscores."""
    return F.regexp_replace(F.lower(F.trim(c)), r"[\s-]+", "_")


def quotas(have: dict[str, int], targets: dict[str, tuple[float, int]], total: int | None) -> dict[str, float]:
    """Tokens to take of each source. Without a total, the largest at which no source with documents exceeds its cap, the
    shares of targets without documents being left unfilled."""
    cap = {s: have.get(s, 0) * max(0, r) for s, (_, r) in targets.items()}
    if total is None:
        fits = [cap[s] / share for s, (share, _) in targets.items() if share > 0 and cap[s] > 0]
        total = min(fits) if fits else 0
    return {s: min(total * share, cap[s]) for s, (share, _) in targets.items()}


def split_blocks(counts: dict[str, int], shards: int, seed: int) -> dict[int, dict[str, tuple[int, int]]]:
    """{shard: {source: (from, until)}}: the run of each source's permuted blocks that a shard draws."""
    names = sorted(counts)
    out: dict[int, dict[str, tuple[int, int]]] = {}

    def deal(lo: int, hi: int, begin: np.ndarray, n: np.ndarray):
        if hi - lo == 1:
            out[lo] = {s: (int(b), int(b + k)) for s, b, k in zip(names, begin, n) if k}
            return
        mid = (lo + hi) // 2
        rng = np.random.default_rng([seed, lo, hi])
        left_size = round(int(n.sum()) * (mid - lo) / (hi - lo))
        # the marginal method needs no room for the whole population
        left = rng.multivariate_hypergeometric(n, left_size, method="marginals") if n.sum() else n
        deal(lo, mid, begin, left)
        deal(mid, hi, begin + left, n - left)

    deal(0, max(1, shards), np.zeros(len(names), np.int64), np.array([counts[s] for s in names], np.int64))
    return out


def _in_order(rows: DataFrame, by: list[str], value: str | None, n: int, per_task: int = 200_000) -> DataFrame:
    """`rows` (source, h, ...) with rank, from 0, and upto, the sum of `value` up to the row, in order of (h, by) within each source.
    A source's rows are cut by ranges of h, so that each range is ordered in a task of its own and only its sum goes on."""
    bits = max(0, math.ceil(math.log2(max(1, n / per_task))))
    rows = rows.withColumn("_range", F.shiftright("h", 64 - bits) if bits else F.lit(0).cast("bigint"))
    worth = F.col(value) if value else F.lit(0)
    sums = rows.groupBy("source", "_range").agg(F.count("*").alias("_n"), F.sum(worth).alias("_s"))
    before = Window.partitionBy("source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("source", "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"), F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_s0"))
    inner = Window.partitionBy("source", "_range").orderBy("h", *by)
    out = rows.withColumn("_r", F.row_number().over(inner) - 1).withColumn("_u", F.sum(worth).over(inner.rowsBetween(Window.unboundedPreceding, 0)))
    out = out.join(starts, ["source", "_range"])
    return out.withColumn("rank", (F.col("_n0") + F.col("_r")).cast("bigint")).withColumn("upto", F.col("_s0") + F.col("_u")).drop("_range", "_n", "_s", "_n0", "_s0", "_r", "_u")


def mix(docs: DataFrame, targets: DataFrame, total_tokens: int | None = None, shards: int | None = None, block_tokens: int = 20_000, shard_tokens: int = 200_000_000, seed: int = 5) -> tuple[DataFrame, DataFrame]:
    """(records, report) for docs (doc_id, source, n_tokens) and targets (source, target_share, max_repeats).

    records: shard, position, doc_id, source, n_tokens, pass. report: source, target_share, reached_share, n_tokens, n_records,
    most_repeats, available_tokens; one row per target and one, with share 0, per source without a target.

    Sources match after `clean_source`; records of null sources or sources without a target are not used. Records without
    tokens take part in whole passes only. Without a number of shards there are 16, or one for `shard_tokens` if that is more. Blocks are whole records, so a share is met to within a block. Repeated ids are
    distinct records. Empty tables give empty records; the report still names every target.
    """
    spark = docs.sparkSession
    wanted: dict[str, tuple[float, int]] = {}
    for r in small_rows(targets.where("source is not null").select(clean_source(F.col("source")).alias("source"), "target_share", "max_repeats"), "the targets", MOST_SOURCES):
        share, reps = wanted.get(r.source, (0.0, 0))
        wanted[r.source] = (share + (r.target_share or 0.0), max(reps, r.max_repeats or 0))
    rows = docs.where("doc_id is not null").select("doc_id", clean_source(F.col("source")).alias("source"), F.coalesce("n_tokens", F.lit(0)).cast("bigint").alias("n_tokens"))
    rows = written(rows, "sizes")
    have = {r.source: r.n for r in small_rows(rows.groupBy("source").agg(F.sum("n_tokens").alias("n")), "the sources", MOST_SOURCES)}
    quota = quotas(have, wanted, total_tokens)
    whole = {s: int(q // have[s]) if have.get(s) else 0 for s, q in quota.items()}
    rest = {s: q - whole[s] * have.get(s, 0) for s, q in quota.items()}

    # blocks: a source's records are spread over hash buckets of about a block's size, so no source is sorted in one task
    n_buckets = {s: max(1, -(-n // block_tokens)) for s, n in have.items() if s in wanted}
    buckets = F.lit(1)
    for s, n in n_buckets.items():
        buckets = F.when(F.col("source") == s, F.lit(n)).otherwise(buckets)
    used = rows.where(F.col("source").isin(list(wanted))) if wanted else rows.limit(0)
    used = used.withColumn("block", F.pmod(F.xxhash64(F.lit(seed), "doc_id"), buckets.cast("bigint")))
    sized = used.groupBy("source", "block").agg(F.sum("n_tokens").alias("n"))
    # at most one row per block_tokens tokens of the corpus; their order is the permutation, by hash
    sized = written(sized.withColumn("h", F.xxhash64(F.lit(seed + 1), "source", "block")), "sizes_of_blocks")
    ranked = _in_order(sized, ["block"], "n", sized.count())
    limit = F.lit(0.0)
    passes = F.lit(0)
    for s in wanted:
        limit = F.when(F.col("source") == s, F.lit(float(rest[s]))).otherwise(limit)
        passes = F.when(F.col("source") == s, F.lit(whole[s])).otherwise(passes)
    # the block that crosses the quota is taken if that leaves the smaller error
    partly = (F.col("upto") - F.col("n") / 2 <= limit) & (limit > 0)
    ranked = written(ranked.select("source", "block", "rank", (passes + F.when(partly, 1).otherwise(0)).cast("int").alias("times")), "blocks")

    # copies of blocks: copy c of the block at rank k is item c * n_blocks + k of its source
    n_blocks = {r.source: r.n for r in ranked.groupBy("source").agg(F.count("*").alias("n")).collect()}
    n_items = {r.source: int(r.n or 0) for r in ranked.groupBy("source").agg(F.sum("times").alias("n")).collect()}
    shards = shards or max(16, math.ceil(sum(quota.values()) / shard_tokens))
    dealt = split_blocks(n_items, shards, seed) if n_items else {}
    ends = {s: (np.array([by[s][1] for by in dealt.values() if s in by]), np.array([shard for shard, by in dealt.items() if s in by])) for s in n_items}
    size = F.lit(1)
    for s, n in n_blocks.items():
        size = F.when(F.col("source") == s, F.lit(n)).otherwise(size)
    copies = ranked.where("times > 0").select("source", "block", "rank", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("pass"))
    copies = copies.withColumn("item", (F.col("pass") - 1) * size + F.col("rank"))
    # a permutation of each source's items independent of passes, so that copies of a block part
    copies = _in_order(copies.drop("rank").withColumn("h", F.xxhash64(F.lit(seed + 2), "source", "item")), ["item"], None, sum(n_items.values())).withColumnRenamed("rank", "slot")

    def place(batches):
        """The shard whose run of the source's slots holds the row's."""
        for b in batches:
            slot, source = b.column("slot").to_numpy(), np.array(b.column("source").to_pylist(), object)
            shard = np.zeros(len(slot), np.int32)
            for s in set(source.tolist()):
                until, which = ends[s]
                mine = source == s
                shard[mine] = which[np.searchsorted(until, slot[mine], side="right")]
            yield pa.RecordBatch.from_arrays([b.column("source"), b.column("block"), b.column("pass"), pa.array(shard)], names=["source", "block", "pass", "shard"])

    placed = copies.select("source", "block", "pass", "slot").mapInArrow(place, "source string, block bigint, pass int, shard int")
    placed = placed.select(F.col("source").alias("b_source"), F.col("block").alias("b_block"), "pass", "shard")
    picked = used.join(placed, (used.source == placed.b_source) & (used.block == placed.b_block)).select("shard", "doc_id", "source", "n_tokens", "pass")
    local = Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(seed + 3), "doc_id", "pass"), "doc_id", "pass", "n_tokens")
    records = written(picked.withColumn("position", F.row_number().over(local)).select("shard", "position", "doc_id", "source", "n_tokens", "pass"), "mixture")

    got = records.groupBy("source").agg(F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("n_records"), F.max("pass").alias("most_repeats"))
    total = float(records.agg(F.sum("n_tokens")).first()[0] or 0)
    named = sorted({*wanted, *(s for s in have if s is not None)})
    goal = spark.createDataFrame([(s, float(wanted.get(s, (0.0, 0))[0]), int(have.get(s, 0) or 0)) for s in named], "g_source string, target_share double, available_tokens bigint") if named else spark.createDataFrame([], "g_source string, target_share double, available_tokens bigint")
    report = goal.join(got, goal.g_source == got.source, "left").select(
        F.col("g_source").alias("source"),
        "target_share",
        (F.coalesce("n_tokens", F.lit(0)) / F.lit(total or 1.0)).alias("reached_share"),
        F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"),
        F.coalesce("n_records", F.lit(0)).alias("n_records"),
        F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"),
        "available_tokens",
    )
    return records, report
