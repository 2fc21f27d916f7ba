"""Most similar vectors for every vector: score-aware (anisotropic) quantisation, four-bit table scans, exact reranking.

Plan
* a bounded sample (`Params.sample` rows, or `Params.leaf_sample` a partition if that is more) fits the partition centres, in
  two levels beyond `flat_leaves` of them, and 4-bit codebooks (two dimensions a subspace, 16 centres);
* every row is assigned once, written, and sent to its `spill` nearest partitions with its code and its own vector, so one
  shuffle brings everything a partition needs: all pairs of rows are scored from the tables, and the best `rerank` of each row
  are scored again from the vectors themselves, kept at 24 bits a component;
* the best k of a row over its partitions are kept.

The number of partitions follows the rows, so that the pairs scored for a row stay the same at every size.

Skew: of a group of exactly equal vectors, only the first k+1 keys enter the index; the others get the first k keys of
their group, whose cosine of 1 nothing exceeds. A partition above `block_rows` is cut into blocks by hash; each block, and
each pair of blocks, becomes a task of its own, so no partition is ever held in one task.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.session import BROADCAST_ROWS, written

PAIRS_SCHEMA = "ns string, key string, neighbour string, cosine double"


@dataclass(frozen=True)
class Params:
    k: int = 5
    sample: int = 20_000  #: rows that fit centres and codebooks; the index itself holds every row
    leaf_sample: int = 16  #: the same for each partition, where that is more
    leaf_rows: int = 4096
    flat_leaves: int = 1024  #: partitions up to which there is one level of centres
    max_leaves: int = 65_536
    spill: int = 3
    rerank: int = 64
    block_rows: int = 40_000
    threshold: float = 0.2  #: cosine above which a score matters; it sets the weight of parallel residuals
    rounds: int = 8
    min_cosine: float = -1.0  #: pairs below it are not returned


@dataclass(frozen=True)
class Index:
    coarse: np.ndarray  # cells x dim
    centres: np.ndarray  # leaves x dim, those of a cell together
    first: np.ndarray  # each cell's first leaf, and the end
    books: np.ndarray  # subspaces x 16 x 2
    weight: float

    def nearest(self, x: np.ndarray, spill: int, cells: int = 8) -> np.ndarray:
        """The `spill` leaves with the most similar centres of each unit vector; in two levels, of the nearest cells."""
        if len(self.coarse) == 1:
            sim = x @ self.centres.T
            return np.argpartition(-sim, spill - 1, axis=1)[:, :spill].astype(np.int32)
        cells = min(cells, len(self.coarse))
        near = np.argpartition(-(x @ self.coarse.T), cells - 1, axis=1)[:, :cells]
        best = np.full((len(x), cells, spill), -2.0, np.float32)
        leaf = np.full((len(x), cells, spill), -1, np.int32)
        for c in np.unique(near):
            row, at = np.nonzero(near == c)
            sim = x[row] @ self.centres[self.first[c] : self.first[c + 1]].T
            k = min(spill, sim.shape[1])
            top = np.argpartition(-sim, k - 1, axis=1)[:, :k]
            best[row, at, :k] = np.take_along_axis(sim, top, 1)
            leaf[row, at, :k] = top + self.first[c]
        order = np.argpartition(-best.reshape(len(x), -1), spill - 1, axis=1)[:, :spill]
        return np.take_along_axis(leaf.reshape(len(x), -1), order, 1)


def _unit(v: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(v, axis=1, keepdims=True)
    return v / np.where(n > 0, n, 1)


def _spherical_kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = np.concatenate([(x[i : i + 8192] @ c.T).argmax(1) for i in range(0, len(x), 8192)])
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        empty = np.bincount(near, minlength=k) == 0
        sums[empty] = x[rng.choice(len(x), int(empty.sum()))]
        c = _unit(sums)
    return c


def encode(x: np.ndarray, books: np.ndarray, weight: float, passes: int = 2) -> np.ndarray:
    """Codes (rows x subspaces) of unit vectors: coordinate descent on |r|^2 + weight * <r, x>^2, r the residual."""
    n, s = len(x), len(books)
    out = np.empty((n, s), np.uint8)
    b2 = (books**2).sum(2)
    for a in range(0, n, 1024):
        xs = np.ascontiguousarray(x[a : a + 1024].reshape(-1, s, 2).transpose(1, 0, 2))
        rows = np.arange(xs.shape[1])
        x2 = (xs**2).sum(2)[:, :, None]
        dot = np.matmul(xs, books.transpose(0, 2, 1))  # subspaces x rows x entries, of which all else is made
        size, share = x2 - 2 * dot + b2[:, None, :], x2 - dot  # of the residual, and its product with the vector
        codes = size.argmin(2)
        par = np.take_along_axis(share, codes[:, :, None], 2)[:, :, 0]
        total = par.sum(0)
        for _ in range(passes):
            for j in range(s):
                rest = total - par[j]
                cost = share[j] + rest[:, None]
                cost *= cost
                cost *= weight
                cost += size[j]
                codes[j] = cost.argmin(1)
                par[j] = share[j][rows, codes[j]]
                total = rest + par[j]
        out[a : a + 1024] = codes.T
    return out


def fit(sample: np.ndarray, n_rows: int, p: Params, seed: int = 7) -> Index:
    """Centres and codebooks from a sample of unit vectors. An odd dimension is not supported by the two-dimensional subspaces
    and is padded by the caller."""
    rng = np.random.default_rng(seed)
    x = sample.astype(np.float32)
    leaves = int(min(max(1, -(-n_rows // p.leaf_rows)), p.max_leaves, len(x)))
    dim = x.shape[1]
    if leaves <= p.flat_leaves:
        coarse, centres, first = np.zeros((1, dim), np.float32), _spherical_kmeans(x, leaves, p.rounds, rng), np.array([0, leaves])
    else:
        coarse = _spherical_kmeans(x, int(leaves**0.5), p.rounds, rng)
        cell = np.concatenate([(x[i : i + 8192] @ coarse.T).argmax(1) for i in range(0, len(x), 8192)])
        coarse = coarse[np.unique(cell)]  # each cell holds as many leaves as its share of the sample
        cell = np.unique(cell, return_inverse=True)[1]
        size = np.bincount(cell)
        each = np.minimum(np.maximum(1, np.round(leaves * size / len(x)).astype(int)), size)
        centres = np.concatenate([_spherical_kmeans(x[cell == c], k, p.rounds, rng) for c, k in enumerate(each)])
        first = np.concatenate([[0], np.cumsum(each)])
    t2 = p.threshold**2
    weight = np.float32((dim - 1) * t2 / (1 - t2))  # h_parallel / h_orthogonal - 1 for unit vectors, at least 0
    weight = max(weight - 1, np.float32(0))
    part = x[rng.permutation(len(x))[:8192]]
    xs = part.reshape(len(part), dim // 2, 2)
    books = np.stack([xs[rng.choice(len(part), 16, replace=len(part) < 16), j] for j in range(dim // 2)])
    for _ in range(p.rounds):
        codes = encode(part, books, weight, 1)
        recon = np.stack([books[j][codes[:, j]] for j in range(dim // 2)], 1)
        par = ((xs - recon) * xs).sum(2)
        total = par.sum(1)
        for j in range(dim // 2):
            v = xs[:, j]
            goal = total - par[:, j] + (v * v).sum(1)
            for c in range(16):
                m = codes[:, j] == c
                if not m.any():
                    books[j, c] = v[rng.integers(len(v))]
                    continue
                a = v[m]
                lhs = m.sum() * np.eye(2, dtype=np.float32) + weight * a.T @ a
                books[j, c] = np.linalg.solve(lhs, a.sum(0) + weight * (goal[m, None] * a).sum(0))
            recon_j = books[j][codes[:, j]]
            new = ((v - recon_j) * v).sum(1)
            total = total - par[:, j] + new
            par[:, j] = new
    return Index(coarse, centres, first, books.astype(np.float32), float(weight))


def pack(codes: np.ndarray) -> np.ndarray:
    """Two four-bit codes a byte; an odd number of subspaces gets an empty last half."""
    if codes.shape[1] % 2:
        codes = np.concatenate([codes, np.zeros((len(codes), 1), np.uint8)], 1)
    return (codes[:, 0::2] << 4) | codes[:, 1::2]


def reconstruct(packed: np.ndarray, books: np.ndarray) -> np.ndarray:
    """The vectors that packed codes stand for, out of the tables."""
    s = len(books)
    pair = np.zeros((256, 4), np.float32)
    out = np.empty((len(packed), 2 * s), np.float32)
    for b in range(packed.shape[1]):
        pair[:, :2] = np.repeat(books[2 * b], 16, axis=0)
        if 2 * b + 1 < s:
            pair[:, 2:] = np.tile(books[2 * b + 1], (16, 1))
        out[:, 4 * b : 4 * b + 4] = pair[packed[:, b], : out.shape[1] - 4 * b]
    return out


def table_scan(queries: np.ndarray, packed: np.ndarray, books: np.ndarray) -> np.ndarray:
    """Scores (rows x queries) of packed codes. Sums over look-ups of query times table entry are the products of the queries
    with the entries that the codes name; taken together they are one matrix product, five times as fast here as look-ups."""
    return reconstruct(packed, books) @ queries.T


def to_24_bits(x: np.ndarray) -> np.ndarray:
    """Rows of components within -1 and 1 as little-endian bytes, three a component."""
    q = np.round(x * (2**23 - 1)).astype("<i4")
    return np.ascontiguousarray(q.view(np.uint8).reshape(len(x), -1, 4)[:, :, :3]).reshape(len(x), -1)


def from_24_bits(b: np.ndarray) -> np.ndarray:
    q = np.zeros((len(b), b.shape[1] // 3, 4), np.uint8)
    q[:, :, 1:] = b.reshape(len(b), -1, 3)
    return (q.view("<i4")[:, :, 0] >> 8).astype(np.float64)


def _binary(rows: np.ndarray) -> pa.Array:
    """A binary column of equally long rows of bytes."""
    cuts = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(cuts), pa.py_buffer(np.ascontiguousarray(rows))])


def _bytes(col: pa.ChunkedArray, width: int) -> np.ndarray:
    parts = []
    for c in col.chunks:
        cuts = np.frombuffer(c.buffers()[1], np.int32)[c.offset : c.offset + len(c) + 1]
        parts.append(np.frombuffer(c.buffers()[2], np.uint8)[cuts[0] : cuts[-1]])
    return np.concatenate(parts).reshape(-1, width)


def _best(scores: np.ndarray, m: int, group: int = 16) -> np.ndarray:
    """The places of the m greatest of each row. The m greatest lie in the m groups of greatest maximum."""
    n = scores.shape[1]
    if n <= 4 * m * group:
        return np.argpartition(-scores, m - 1, axis=1)[:, :m]
    wide = -(-n // group)
    top = scores[:, :wide].copy()
    for k in range(1, group):
        part = scores[:, k * wide : (k + 1) * wide]
        np.maximum(top[:, : part.shape[1]], part, out=top[:, : part.shape[1]])
    groups = np.argpartition(top, wide - m, axis=1)[:, wide - m :].astype(np.int32)
    cand = (groups[:, :, None] + np.arange(0, wide * group, wide, dtype=np.int32)).reshape(len(scores), -1)
    value = np.take_along_axis(scores, np.minimum(cand, n - 1), 1)
    if wide * group > n:
        value[cand >= n] = -np.inf
    return np.take_along_axis(cand, np.argpartition(value, value.shape[1] - m, axis=1)[:, -m:], 1)


def block_pairs(ask: np.ndarray, of: np.ndarray, rank: np.ndarray, x: np.ndarray, recon: np.ndarray, p: Params) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, neighbour, cosine) of the best k among the rows `of` for each of the rows `ask`, itself left out; all by position.
    Equal cosines go by rank, so that the answer does not depend on how rows are laid out."""
    none = np.empty(0, np.int64)
    same = ask is of
    m = min(p.rerank, len(of) - same)
    if m < 1 or not len(ask):
        return none, none, np.empty(0)
    qs, cs, scores = [], [], []
    table, x32 = recon[of].T.copy(), x[ask].astype(np.float32)
    step = max(16, min(512, (4 << 20) // (4 * len(of))))  # scores stay in the processor's cache
    room = np.empty((step, len(of)), np.float32)
    for a in range(0, len(ask), step):
        q = ask[a : a + step]
        approx = np.matmul(x32[a : a + step], table, out=room[: len(q)])
        if same:
            approx[np.arange(len(q)), np.arange(a, a + len(q))] = -np.inf
        cand = of[_best(approx, m)]
        exact = np.einsum("qmd,qd->qm", x[cand], x[q])
        order = np.lexsort((rank[cand], -np.round(exact, 12)), axis=1)[:, : p.k]
        value = np.take_along_axis(exact, order, 1)
        keep = value >= p.min_cosine
        qs.append(np.broadcast_to(q[:, None], order.shape)[keep])
        cs.append(np.take_along_axis(cand, order, 1)[keep])
        scores.append(value[keep])
    return np.concatenate(qs), np.concatenate(cs), np.concatenate(scores)


def usable_vectors(df: DataFrame, key: str, vector: str, version: str, model: str, dim: int) -> DataFrame:
    """(key, vec): per key the latest usable row, that is, of the given model, with `dim` finite values, not all zero. Ties go
    to the greatest vector. Null keys are left out. The vector is packed as little-endian float32."""
    v = F.col(vector)
    ok = (F.col("model") == model) & (F.size(v) == dim)
    ok = ok & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    kept = df.where(F.col(key).isNotNull() & ok).select(F.col(key).cast("string").alias("key"), F.col(version).alias("at"), v.alias("vec"))

    def latest(rows: DataFrame) -> DataFrame:
        return rows.groupBy("key").agg(F.max(F.struct("at", "vec")).alias("r")).select("key", F.col("r.vec").alias("vec"))

    # few keys have several rows: only those need their vectors shuffled, as long as their list is small enough to send round
    several = written(kept.groupBy("key").count().where("count > 1").select("key"), "several")
    if several.count() > BROADCAST_ROWS:
        return latest(kept)
    single = kept.join(F.broadcast(several), "key", "left_anti").select("key", "vec")
    return single.unionByName(latest(kept.join(F.broadcast(several), "key", "left_semi")))


def _equal_groups(rows: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """(rows to index, rows outside with their neighbours), where some vector occurs more than k+1 times."""
    # a digest of eight bytes is enough to leave most rows out of the exact comparison
    signed = rows.withColumn("sig", F.xxhash64("vec"))
    several = signed.groupBy("ns", "sig").count().where(F.col("count") > k + 1).select("ns", "sig")
    members = signed.join(several, ["ns", "sig"]).select("ns", "key", F.sha2(F.array_join(F.col("vec").cast("array<string>"), ","), 256).alias("sig"))
    crowded = members.groupBy("ns", "sig").count().where(F.col("count") > k + 1).select("ns", "sig")
    members = written(members.join(crowded, ["ns", "sig"]), "equal")
    order = Window.partitionBy("ns", "sig").orderBy("key")
    first = members.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= k + 1)  # limited before the shuffle
    outside = members.join(first.select("ns", "key"), ["ns", "key"], "left_anti")
    indexed = rows.join(outside.select("ns", "key"), ["ns", "key"], "left_anti")
    near = first.where(F.col("rn") <= k).select("ns", "sig", F.col("key").alias("neighbour"))
    pairs = outside.join(near, ["ns", "sig"]).select("ns", "key", "neighbour", F.lit(1.0).alias("cosine"))
    return indexed, pairs


def nearest(rows: DataFrame, p: Params = Params()) -> DataFrame:
    """(ns, key, neighbour, cosine, rank): for every row of (ns, key, vec) its k most similar others of the same ns.

    Equal cosines rank by key. A namespace of one row gives no rows, nor does an empty table. min_cosine leaves out pairs
    below it, which never changes the ranks above. Keys must be unique within ns.
    """
    equal = rows.groupBy("ns", F.xxhash64("vec").alias("sig")).count()
    n, most = equal.agg(F.sum("count"), F.max("count")).first()
    if not n:
        return rows.sparkSession.createDataFrame([], PAIRS_SCHEMA + ", rank int")
    wanted = max(p.sample, p.leaf_sample * min(p.max_leaves, -(-n // p.leaf_rows)))
    picked = rows.select("vec") if n <= 2 * wanted else rows.where(F.pmod(F.xxhash64("ns", "key"), F.lit(n // wanted)) == 0).select("vec").limit(2 * wanted)
    sample = np.array([r.vec for r in picked.collect()], np.float32)
    dim = sample.shape[1]
    pad = dim % 2
    if pad:
        sample = np.pad(sample, ((0, 0), (0, 1)))
    index = fit(_unit(sample), n, p)
    width, code_width, spill = dim + pad, -(-((dim + pad) // 2) // 2), min(p.spill, len(index.centres))
    split = _equal_groups(rows, p.k) if most > p.k + 1 else None
    indexed = split[0] if split else rows

    def assign(batches):
        for b in batches:
            if not b.num_rows:
                continue
            raw = b.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, dim)
            x = _unit(np.pad(raw, ((0, 0), (0, pad))).astype(np.float64))
            x32 = x.astype(np.float32)
            leaves = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * spill), pa.array(index.nearest(x32, spill).ravel()))
            yield pa.RecordBatch.from_arrays([b.column("ns"), b.column("key"), leaves, _binary(to_24_bits(x)), _binary(pack(encode(x32, index.books, index.weight)))], names=["ns", "key", "leaves", "vec", "code"])

    assigned = written(indexed.mapInArrow(assign, "ns string, key string, leaves array<int>, vec binary, code binary"), "assigned")
    stored = assigned.select("ns", F.explode("leaves").alias("leaf"), "key", "vec", "code").where("leaf >= 0")
    full = assigned.select("ns", F.explode("leaves").alias("leaf")).groupBy("ns", "leaf").count().where(F.col("count") > p.block_rows)
    cut = full.select("ns", "leaf", F.ceil(F.col("count") / (p.block_rows // 2)).cast("int").alias("blocks"))
    if cut.limit(1).count():  # no more than max_leaves a namespace
        stored = stored.join(cut, ["ns", "leaf"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        stored = stored.withColumn("own", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
        stored = stored.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        stored = stored.withColumn("i", F.least("own", "other").cast("int")).withColumn("j", F.greatest("own", "other").cast("int"))
    else:
        stored = stored.withColumn("own", F.lit(0)).withColumn("i", F.lit(0)).withColumn("j", F.lit(0))
    stored = stored.select("ns", "leaf", "i", "j", "own", "key", "vec", "code")

    def search(table: pa.Table) -> pa.Table:
        keys, own = table.column("key"), table.column("own").to_numpy()
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        rank = np.empty(len(keys), np.int64)
        rank[np.argsort(np.array(keys.to_pylist(), object), kind="stable")] = np.arange(len(keys))
        x = _unit(from_24_bits(_bytes(table.column("vec"), 3 * width)))
        recon = reconstruct(_bytes(table.column("code"), code_width), index.books)
        if i == j:
            every = np.arange(len(keys))
            q, c, s = block_pairs(every, every, rank, x, recon, p)
        else:  # each block on its own is another task
            a, z = np.flatnonzero(own == i), np.flatnonzero(own == j)
            q, c, s = (np.concatenate(v) for v in zip(block_pairs(a, z, rank, x, recon, p), block_pairs(z, a, rank, x, recon, p)))
        ns = table.column("ns")[0].as_py()
        return pa.table({"ns": pa.array([ns] * len(q), pa.string()), "key": keys.take(pa.array(q)), "neighbour": keys.take(pa.array(c)), "cosine": pa.array(s, pa.float64())})

    pairs = stored.groupBy("ns", "leaf", "i", "j").applyInArrow(search, PAIRS_SCHEMA)
    if split:
        pairs = pairs.unionByName(split[1])
    # one shuffle serves both steps
    best = pairs.repartition("ns", "key").groupBy("ns", "key", "neighbour").agg(F.max("cosine").alias("cosine"))
    order = Window.partitionBy("ns", "key").orderBy(F.round("cosine", 12).desc(), "neighbour")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= p.k)


def exact_nearest(rows: DataFrame, queries: DataFrame, k: int, block: int = 20_000) -> DataFrame:
    """The same columns by comparing a stated query set to all rows, `block` queries at a time; for measuring recall."""
    n = queries.count()
    if not n:
        return rows.sparkSession.createDataFrame([], PAIRS_SCHEMA + ", rank int")
    parts = -(-n // block)
    order = Window.partitionBy("ns", "key").orderBy(F.round("cosine", 12).desc(), "neighbour")
    out = None
    for i in range(parts):
        own = queries.where(F.pmod(F.xxhash64("ns", "key"), F.lit(parts)) == i) if parts > 1 else queries
        near = _exact(rows, own.select("ns", "key", "vec").collect(), k).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        out = near if out is None else out.unionByName(near)
    return out


def _exact(rows: DataFrame, qs: list, k: int) -> DataFrame:
    q_ns, q_keys = np.array([r.ns for r in qs], object), np.array([r.key for r in qs], object)
    q_vecs = _unit(np.array([r.vec for r in qs], np.float64)) if qs else np.zeros((0, 1))

    def scan(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x = _unit(b.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1).astype(np.float64))
            ns, keys = np.array(b.column("ns").to_pylist(), object), np.array(b.column("key").to_pylist(), object)
            rank = np.empty(len(keys), np.int64)
            rank[np.argsort(keys, kind="stable")] = np.arange(len(keys))
            for a in range(0, len(q_keys), 256):
                s = q_vecs[a : a + 256] @ x.T
                s[(q_ns[a : a + 256, None] != ns) | (q_keys[a : a + 256, None] == keys)] = -2
                top = np.lexsort((np.broadcast_to(rank, s.shape), -np.round(s, 12)), axis=1)[:, :k]
                value = np.take_along_axis(s, top, 1)
                good = value > -2
                qi = np.broadcast_to(np.arange(a, a + len(s))[:, None], top.shape)[good]
                yield pa.RecordBatch.from_arrays([pa.array(q_ns[qi].tolist(), pa.string()), pa.array(q_keys[qi].tolist(), pa.string()), pa.array(keys[top[good]].tolist(), pa.string()), pa.array(value[good], pa.float64())], names=["ns", "key", "neighbour", "cosine"])

    return rows.mapInArrow(scan, PAIRS_SCHEMA)
