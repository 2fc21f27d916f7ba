"""Dense vectors: codec, distances, normalisation, exact top-k, hashed embeddings and a sharded HNSW index."""

from __future__ import annotations

import hashlib
import heapq
import io
import json
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, FloatType
from pyspark.sql.window import Window

from millrace.operators.tables import require_dim
from millrace.session import claim, exists, fresh_path, names_in, read_text, remove, small_rows

#: Names of metrics; any other name means cosine (fixed values).
METRICS = {"l2": "l2", "euclidean": "l2", "ip": "ip", "inner": "ip", "dot": "ip", "cosine": "cosine", "cos": "cosine", "": "cosine"}
#: Questions are compared to all vectors; a larger set than this must be split by the caller.
MOST_QUERIES = 20_000


def parse_metric(name: str) -> tuple[str, bool]:
    found = METRICS.get(name.strip().lower())
    return found or "cosine", found is not None


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def distance(a: Column, b: Column, metric: str) -> Column:
    """Squared L2, 1 - dot, or 1 - cosine (1 if a vector is zero), in double precision."""
    if metric == "l2":
        return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) ** 2), F.lit(0.0), lambda s, x: s + x)
    if metric == "ip":
        return 1 - dot(a, b)
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n == 0, F.lit(1.0)).otherwise(1 - dot(a, b) / n)


def normalise(v: Column) -> Column:
    n = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: x.cast("double") / F.when(n == 0, F.lit(1.0)).otherwise(n))


@F.pandas_udf(BinaryType())
def encode_f32(v: pd.Series) -> pd.Series:
    return v.map(lambda x: None if x is None else np.asarray(x, "<f4").tobytes())


@F.pandas_udf(ArrayType(FloatType()))
def decode_f32(b: pd.Series) -> pd.Series:
    def one(x):
        if x is None:
            return None
        if len(x) % 4:
            raise ValueError("not a whole number of floats")
        return np.frombuffer(x, "<f4")

    return b.map(one)


def hash_embedding(text: str, dim: int) -> np.ndarray:
    """A unit vector drawn from a generator seeded with the text's digest."""
    seed = int.from_bytes(hashlib.sha256(text.encode()).digest()[:8], "little")
    v = np.random.default_rng(seed).standard_normal(dim).astype(np.float32)
    return v / (np.linalg.norm(v) or 1)


def hash_embed(text: Column, dim: int = 64) -> Column:
    @F.pandas_udf("array<float>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else hash_embedding(t, dim))

    return run(text)


def embed_by(text: Column, load, dim: int) -> Column:
    """Vectors of unit length by a model: `load` gives, once a task, a function from a list of texts to their vectors. A vector of
    another length than `dim` is an error; null texts give null."""

    def run(it):
        model = load()
        for s in it:
            some = s[s.notna()]
            got = np.asarray(model(some.tolist()), np.float32).reshape(len(some), -1) if len(some) else np.zeros((0, dim), np.float32)
            if got.shape[1] != dim:
                raise ValueError(f"the model gives vectors of length {got.shape[1]}, not {dim}")
            n = np.linalg.norm(got, axis=1, keepdims=True)
            out = pd.Series([None] * len(s), dtype=object)
            for at, v in zip(np.flatnonzero(s.notna()), got / np.where(n > 0, n, 1)):
                out.iat[at] = v
            yield out

    run.__annotations__ = {"it": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "array<float>")(text)


def _scores(q: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    """Distances (queries x rows)."""
    if metric == "l2":
        return np.maximum((q**2).sum(1)[:, None] + (x**2).sum(1)[None, :] - 2 * q @ x.T, 0)
    if metric == "ip":
        return 1 - q @ x.T
    n = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(x, axis=1)[None, :]
    return np.where(n == 0, 1.0, 1 - (q @ x.T) / np.where(n == 0, 1, n))


def top_k(queries: DataFrame, base: DataFrame, k: int = 50, metric: str = "cosine", digits: int = 6, exclude_self: bool = False) -> DataFrame:
    """(query_id, item, distance, rank) for queries (query_id, vector) and base (item, vector), exactly; ties go by item.

    The stated queries go to every task; each Arrow batch of the base is one matrix product and leaves k rows a query, so
    only those are shuffled. Null vectors take no part; a length that differs is an error.
    """
    qs = small_rows(queries.where("vector is not null").select("query_id", "vector"), "the query set", MOST_QUERIES)
    id_type, item_type = queries.schema["query_id"].dataType.simpleString(), base.schema["item"].dataType.simpleString()
    schema = f"query_id {id_type}, item {item_type}, distance double"
    order = Window.partitionBy("query_id").orderBy("distance", "item")
    if not qs:
        return queries.sparkSession.createDataFrame([], schema + ", rank int")
    q = np.array([r.vector for r in qs], np.float64)
    ids = [r.query_id for r in qs]

    def scan(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x = np.array(b.column("vector").to_pylist(), np.float64)
            items = np.array(b.column("item").to_pylist())
            for a in range(0, len(q), 512):
                d = np.round(_scores(q[a : a + 512], x, metric), digits) + 0.0
                if exclude_self:
                    d[np.array(ids[a : a + 512])[:, None] == items[None, :]] = np.inf
                m = min(k, d.shape[1])
                top = np.lexsort((np.broadcast_to(items, d.shape), d), axis=1)[:, :m]
                got = d[np.arange(len(d))[:, None], top]
                ok = np.isfinite(got)
                rows = np.broadcast_to(np.arange(len(d))[:, None], top.shape)[ok]
                yield pa.RecordBatch.from_arrays([pa.array([ids[a + i] for i in rows]), pa.array(items[top[ok]].tolist()), pa.array(got[ok])], names=["query_id", "item", "distance"]).cast(_arrow(schema))

    found = base.where("vector is not null").select("item", "vector").mapInArrow(scan, schema)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _arrow(schema: str) -> pa.Schema:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64()}
    return pa.schema([(n, kinds[t]) for n, t in (c.split() for c in schema.split(", "))])


class Hnsw:
    """One shard's graph: layers of neighbour lists, insertion with a diversity heuristic, best-first search."""

    def __init__(self, m: int = 16, ef_build: int = 200, metric: str = "cosine", heuristic: bool = True, seed: int = 1337):
        if m < 2 or ef_build < 1:
            raise ValueError("m of at least 2 and ef_build of at least 1")
        self.m, self.m0, self.ef_build, self.metric, self.heuristic = m, 2 * m, ef_build, metric, heuristic
        self.rng, self.ids, self.layers, self.level, self.entry = np.random.default_rng(seed), [], [], [], -1
        self.rows, self.at = np.zeros((0, 0)), {}

    @property
    def x(self) -> np.ndarray:
        return self.rows[: len(self.ids)]

    def _prepare(self, v) -> np.ndarray:
        """The stored form of a vector: of unit length for cosine, so that a distance is one product."""
        v = np.asarray(v, np.float64)
        return v / (np.linalg.norm(v) or 1) if self.metric == "cosine" else v

    def _put(self, i: int, v: np.ndarray) -> None:
        if i >= len(self.rows):
            grown = np.zeros((max(64, 2 * len(self.rows)), len(v)))
            if len(self.rows):
                grown[: len(self.rows)] = self.rows
            self.rows = grown
        self.rows[i] = v

    def _d(self, q: np.ndarray, idx) -> np.ndarray:
        part = self.rows[idx]
        if self.metric == "l2":
            part = part - q
            return np.einsum("ij,ij->i", part, part)
        return 1 - part @ q

    def _search(self, q: np.ndarray, starts: list[tuple[float, int]], ef: int, layer: int) -> list[tuple[float, int]]:
        seen, near, best = {i for _, i in starts}, list(starts), [(-d, -i) for d, i in starts]
        heapq.heapify(near)
        heapq.heapify(best)
        while near:
            d, c = heapq.heappop(near)
            if len(best) >= ef and d > -best[0][0]:
                break
            fresh = [j for j in self.layers[layer].get(c, ()) if j not in seen]
            if not fresh:
                continue
            seen.update(fresh)
            for dj, j in zip(self._d(q, fresh), fresh):
                if len(best) < ef or dj < -best[0][0]:
                    heapq.heappush(near, (dj, j))
                    heapq.heappush(best, (-dj, -j))
                    if len(best) > ef:
                        heapq.heappop(best)
        return sorted((-d, -i) for d, i in best)

    def _select(self, cand: list[tuple[float, int]], m: int) -> list[int]:
        if not self.heuristic:
            return [i for _, i in cand[:m]]
        kept: list[int] = []
        for d, i in cand:
            if len(kept) == m:
                break
            if not kept or d < self._d(self.rows[i], kept).min():
                kept.append(i)
        kept += [i for _, i in cand if i not in kept][: m - len(kept)]  # the pruned fill what is left
        return kept

    def add(self, key, v) -> None:
        v = self._prepare(v)
        if self.ids and len(v) != self.rows.shape[1]:
            raise ValueError("dimension differs")
        if key in self.at:  # the same key again replaces the vector and keeps its level
            i = self.at[key]
            self._put(i, v)
            top = self.level[i]
        else:
            i = len(self.ids)
            self.at[key] = i
            self._put(i, v)
            self.ids.append(key)
            top = int(-math.log(max(self.rng.random(), 1e-12)) / math.log(self.m))
            self.level.append(top)
        while len(self.layers) <= top:
            self.layers.append({})
        if self.entry < 0 or len(self.ids) == 1:
            self.entry = i
            for layer in range(top + 1):
                self.layers[layer].setdefault(i, [])
            return
        ep = [(float(self._d(v, [self.entry])[0]), self.entry)]
        for layer in range(self.level[self.entry], top, -1):
            ep = self._search(v, ep, 1, layer)[:1]
        for layer in range(min(top, self.level[self.entry]), -1, -1):
            found = [(d, j) for d, j in self._search(v, ep, self.ef_build, layer) if j != i]
            cap = self.m0 if layer == 0 else self.m
            self.layers[layer][i] = self._select(found, self.m)
            for j in self.layers[layer][i]:
                links = self.layers[layer].setdefault(j, [])
                if i not in links:
                    links.append(i)
                if len(links) > cap:
                    ds = self._d(self.rows[j], links)
                    self.layers[layer][j] = self._select(sorted(zip(ds.tolist(), links)), cap)
            ep = found or ep
        for layer in range(top + 1):
            self.layers[layer].setdefault(i, [])
        if top > self.level[self.entry]:
            self.entry = i

    def search(self, q, k: int, ef: int = 64) -> list[tuple[float, object]]:
        if k < 1:
            raise ValueError("k of at least 1")
        if self.entry < 0:
            return []
        q = self._prepare(q)
        ep = [(float(self._d(q, [self.entry])[0]), self.entry)]
        for layer in range(self.level[self.entry], 0, -1):
            ep = self._search(q, ep, 1, layer)[:1]
        return [(d, self.ids[i]) for d, i in self._search(q, ep, max(ef, k), 0)[:k]]

    def build(self, keys: list, vectors: np.ndarray) -> Hnsw:
        """All vectors at once into an empty graph: each layer's candidates are the exact nearest of the layer, found block by
        block as products, cut by the same diversity heuristic. Far cheaper than adding them one by one. Of a repeated key the
        last vector counts."""
        if self.ids:
            raise ValueError("the graph is not empty")
        last = {k: i for i, k in enumerate(keys)}
        keys = list(last)
        if not keys:
            return self
        x = np.asarray(vectors, np.float64)[list(last.values())]
        if self.metric == "cosine":
            n = np.linalg.norm(x, axis=1, keepdims=True)
            x = x / np.where(n > 0, n, 1)
        self.ids, self.rows, self.at = keys, x, {k: i for i, k in enumerate(keys)}
        self.level = np.minimum(-np.log(np.maximum(self.rng.random(len(keys)), 1e-12)) / math.log(self.m), 12).astype(int).tolist()
        level = np.array(self.level)
        self.entry = int(level.argmax())
        self.layers = [{int(i): [] for i in np.flatnonzero(level >= layer)} for layer in range(int(level.max()) + 1)]
        for layer, links in enumerate(self.layers):
            own, cap = np.fromiter(links, int), self.m0 if layer == 0 else self.m
            many = min(self.ef_build, len(own) - 1)
            if many < 1:
                continue
            half = (x[own] ** 2).sum(1)
            for a in range(0, len(own), 512):
                part = own[a : a + 512]
                d = _scores(x[part], x[own], "l2" if self.metric == "l2" else "ip")
                d[np.arange(len(part)), np.arange(a, a + len(part))] = np.inf
                near = np.argpartition(d, many - 1, axis=1)[:, :many]
                near = np.take_along_axis(near, np.argsort(np.take_along_axis(d, near, 1), axis=1, kind="stable"), 1)
                for i, row, dist in zip(part.tolist(), near, np.take_along_axis(d, near, 1)):
                    c = x[own[row]] @ x[own[row]].T
                    between = half[row][:, None] + half[row][None, :] - 2 * c if self.metric == "l2" else 1 - c
                    links[i] = own[row[self._diverse(dist, between, self.m)]].tolist()
            for i in own.tolist():  # links go both ways, and the fullest lists are cut again
                for j in list(links[i]):
                    if i not in links[j]:
                        links[j].append(i)
            for i in own.tolist():
                if len(links[i]) > cap:
                    ds = self._d(self.rows[i], links[i])
                    links[i] = self._select(sorted(zip(ds.tolist(), links[i])), cap)
            self._connect(links, own)
        return self

    def _diverse(self, dist: np.ndarray, between: np.ndarray, m: int) -> np.ndarray:
        """Places of up to m candidates, nearest first, each nearer to the vector than to any kept before; the pruned fill what is left."""
        if not self.heuristic:
            return np.arange(min(m, len(dist)))
        kept, least = [], np.full(len(dist), np.inf)
        open_ = np.ones(len(dist), bool)
        while len(kept) < m:
            ok = np.flatnonzero(open_ & (dist < least))
            if not len(ok):
                break
            k = int(ok[0])
            kept.append(k)
            open_[: k + 1] = False
            least = np.minimum(least, between[k])
        rest = np.setdiff1d(np.arange(len(dist)), kept)[: m - len(kept)]
        return np.concatenate([np.array(kept, int), rest])

    def _parts(self, links: dict[int, list[int]], own: np.ndarray) -> list[list[int]]:
        part = dict.fromkeys(own.tolist(), -1)
        groups: list[list[int]] = []
        for s in part:
            if part[s] < 0:
                part[s], stack = len(groups), [s]
                groups.append([])
                while stack:
                    v = stack.pop()
                    groups[-1].append(v)
                    for u in links[v]:
                        if part[u] < 0:
                            part[u] = part[s]
                            stack.append(u)
        return groups

    def _connect(self, links: dict[int, list[int]], own: np.ndarray) -> None:
        """Links each part of a layer that no link leaves to the m parts around it, so that a search finds its way between them,
        and goes on until all of the layer is one part."""
        while len(groups := self._parts(links, own)) > 1:
            middle = np.stack([self.rows[g].mean(0) for g in groups])
            apart = _scores(middle, middle, "l2")
            np.fill_diagonal(apart, np.inf)
            for i, near in enumerate(np.argsort(apart, axis=1, kind="stable")[:, : min(self.m, len(groups) - 1)]):
                for j in near.tolist():
                    a = groups[i][int(((self.rows[groups[i]] - middle[j]) ** 2).sum(1).argmin())]
                    b = groups[j][int(((self.rows[groups[j]] - middle[i]) ** 2).sum(1).argmin())]
                    if b not in links[a]:
                        links[a].append(b)
                    if a not in links[b]:
                        links[b].append(a)

    def to_bytes(self) -> bytes:
        """The graph as it is stored: keys, vectors, levels and links."""
        links = [[(i, *js) for i, js in layer.items()] for layer in self.layers]
        flat = [np.fromiter((v for row in layer for v in row), np.int32) for layer in links]
        sizes = [np.array([len(row) for row in layer], np.int32) for layer in links]
        out = io.BytesIO()
        kept = {f"flat{k}": f for k, f in enumerate(flat)} | {f"size{k}": s for k, s in enumerate(sizes)}
        np.savez(out, keys=np.frombuffer(json.dumps(self.ids).encode(), np.uint8), rows=self.x, level=np.array(self.level, np.int16), head=np.array([self.m, self.ef_build, self.entry, self.heuristic, len(links)]), metric=np.frombuffer(self.metric.encode(), np.uint8), **kept)
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> Hnsw:
        z = np.load(io.BytesIO(data))
        m, ef_build, entry, heuristic, n = z["head"].tolist()
        g = cls(m, ef_build, z["metric"].tobytes().decode(), bool(heuristic))
        g.ids, g.rows, g.level, g.entry = json.loads(z["keys"].tobytes()), z["rows"], z["level"].tolist(), entry
        g.at = {k: i for i, k in enumerate(g.ids)}
        for k in range(n):
            cuts = np.concatenate([[0], np.cumsum(z[f"size{k}"])])
            flat = z[f"flat{k}"].tolist()
            g.layers.append({flat[a]: flat[a + 1 : b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())})
        return g


class VectorIndex:
    """An approximate index in a folder of a shared file system: shards of a bounded size, each a graph, written once and read by
    every search. Batches are added as shards of their own; a key added again replaces the former vector. `snapshot` copies the
    index, `VectorIndex(spark, folder)` recovers it."""

    def __init__(self, spark: SparkSession, folder: str):
        if not exists(spark, f"{folder}/config"):
            raise FileNotFoundError(f"no index at {folder}")
        self.spark, self.folder = spark, folder
        self.config = json.loads(read_text(spark, f"{folder}/config"))
        if self.config.get("format") != 1:
            raise ValueError("unknown format of the index")

    @classmethod
    def create(cls, spark: SparkSession, folder: str, dim: int, metric: str = "cosine", model: str | None = None, m: int = 16, ef_build: int = 100, shard_rows: int = 2_000) -> VectorIndex:
        if dim < 1 or m < 2 or ef_build < 1 or shard_rows < 1:
            raise ValueError("dim, ef_build and shard_rows of at least 1, m of at least 2")
        settings = {"format": 1, "dim": dim, "metric": parse_metric(metric)[0], "model": model, "m": m, "ef_build": ef_build, "shard_rows": shard_rows}
        if not claim(spark, f"{folder}/config", json.dumps(settings)):
            raise FileExistsError(f"an index is at {folder}")
        return cls(spark, folder)

    def batches(self) -> list[int]:
        return sorted(int(n) for n in names_in(self.spark, f"{self.folder}/batches") if n.isdigit())

    def _table(self, kind: str) -> DataFrame | None:
        paths = [f"{read_text(self.spark, f'{self.folder}/batches/{n}')}/{kind}" for n in self.batches()]
        return self.spark.read.parquet(*paths) if paths else None

    def check(self, dim: int, model: str | None = None) -> None:
        """An error if vectors of that length or model do not belong here."""
        if dim != self.config["dim"] or model is not None and self.config["model"] not in (None, model):
            raise ValueError(f"the index holds vectors of {self.config['model']} of length {self.config['dim']}")

    def add(self, rows: DataFrame) -> int:
        """Adds rows (item, vector) as one batch and gives its number. All lengths are checked before any row counts; null vectors
        and items are left out."""
        c = self.config
        rows = require_dim(rows.where("vector is not null and item is not null").select("item", "vector"), "vector", c["dim"])
        batches = self.batches()
        number = batches[-1] + 1 if batches else 0
        base = f"{self.folder}/data/{number}-{uuid.uuid4().hex}"
        rows.withColumn("batch", F.lit(number)).write.parquet(f"{base}/rows")
        kept = self.spark.read.parquet(f"{base}/rows")
        shards = max(1, -(-kept.count() // c["shard_rows"]))

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("item", kind="stable")
            g = Hnsw(c["m"], c["ef_build"], c["metric"]).build(pdf["item"].tolist(), np.stack(pdf["vector"].to_numpy()))
            return pd.DataFrame({"batch": [number], "shard": [int(pdf["shard"].iloc[0])], "n": [len(g.ids)], "graph": [g.to_bytes()]})

        shard = F.pmod(F.xxhash64("item"), F.lit(shards)).cast("int").alias("shard")
        kept.select("item", "vector", shard).groupBy("shard").applyInPandas(run, "batch int, shard int, n int, graph binary").write.parquet(f"{base}/shards")
        kept.select("item", "batch", shard).distinct().write.parquet(f"{base}/keys")
        if not claim(self.spark, f"{self.folder}/batches/{number}", base):
            remove(self.spark, base)
            raise RuntimeError(f"batch {number} is there already")
        return number

    def _replaced(self) -> DataFrame | None:
        """(batch, shard, dead): the keys of each shard that a later batch holds as well."""
        if len(self.batches()) < 2:
            return None
        keys = self._table("keys")
        last = keys.groupBy("item").agg(F.max("batch").alias("last"), F.count("*").alias("n")).where("n > 1")
        old = keys.join(last, "item").where("batch < last")
        return old.groupBy("batch", "shard").agg(F.collect_list("item").alias("dead"))  # no more than a shard's rows

    def count(self) -> int:
        keys = self._table("keys")
        return keys.select("item").distinct().count() if keys is not None else 0

    def search(self, queries: DataFrame, k: int = 10, ef: int = 64) -> DataFrame:
        """(query_id, item, distance, rank) for queries (query_id, vector). Every stored shard answers all questions and the best
        are merged: a neighbour is missed only where its own shard misses it. An empty index gives no rows."""
        qs = small_rows(queries.where("vector is not null").select("query_id", "vector"), "the query set", MOST_QUERIES)
        for r in qs[:1]:
            self.check(len(r.vector))
        id_type = queries.schema["query_id"].dataType.simpleString()
        shards = self._table("shards")
        if shards is None:
            return self.spark.createDataFrame([], f"query_id {id_type}, item bigint, distance double, rank int")
        item_type = self._table("keys").schema["item"].dataType.simpleString()
        schema = f"query_id {id_type}, item {item_type}, distance double"
        dead = self._replaced()
        shards = shards.withColumn("dead", F.array().cast(f"array<{item_type}>")) if dead is None else shards.join(dead, ["batch", "shard"], "left")

        def run(batches):
            for b in batches:
                for data, gone in zip(b.column("graph").to_pylist(), b.column("dead").to_pylist()):
                    g, gone = Hnsw.from_bytes(data), set(gone or ())
                    rows = []
                    for r in qs:
                        found = [(d, i) for d, i in g.search(r.vector, k + len(gone), max(ef, k + len(gone))) if i not in gone]
                        rows += [(r.query_id, i, round(float(d), 6)) for d, i in found[:k]]
                    cols = list(zip(*rows)) or [(), (), ()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _arrow(schema))], schema=_arrow(schema))

        order = Window.partitionBy("query_id").orderBy("distance", "item")
        # a shard's graph takes far longer to search than to move
        spread = shards.select("graph", "dead").repartition(max(1, min(shards.count(), 10_000)))
        return spread.mapInArrow(run, schema).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    def snapshot(self, folder: str) -> VectorIndex:
        """The index as it is now, as one batch in a folder of its own."""
        c = self.config
        other = VectorIndex.create(self.spark, folder, c["dim"], c["metric"], c["model"], c["m"], c["ef_build"], c["shard_rows"])
        rows = self._table("rows")
        if rows is not None:
            last = rows.groupBy("item").agg(F.max_by("vector", "batch").alias("vector"))
            other.add(last)
        return other

    def drop(self) -> None:
        remove(self.spark, self.folder)


def hnsw_top_k(queries: DataFrame, base: DataFrame, k: int = 10, shard_rows: int = 2_000, metric: str = "cosine", m: int = 16, ef_build: int = 100, ef: int = 64) -> DataFrame:
    """(query_id, item, distance, rank) of a stored index built for this search."""
    first = base.where("vector is not null").select("vector").first()
    spark = base.sparkSession
    index = VectorIndex.create(spark, fresh_path(spark, "vectors"), len(first.vector) if first else 1, metric, None, m, ef_build, shard_rows)
    index.add(base.select("item", "vector"))
    return index.search(queries, k, ef)


def synthetic(spark: SparkSession, n: int, dim: int, seed: int = 1) -> DataFrame:
    """(item, vector) of gaussian vectors that depend on (seed, item) alone, however the rows are partitioned."""

    def run(batches):
        for b in batches:
            ids = b.column("id").to_pylist()
            vs = [np.random.default_rng([seed, i]).standard_normal(dim).astype(np.float32).tolist() for i in ids]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(vs, pa.list_(pa.float32()))], names=["item", "vector"])

    return spark.range(n).mapInArrow(run, "item bigint, vector array<float>")
