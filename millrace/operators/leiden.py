"""Hierarchical communities by local moves, refinement and aggregation, parted into connected pieces, small ones merged.

One level is: local moves for modularity from single vertices; refinement, the same moves from single vertices within each
community; the refined parts as vertices of a smaller graph, on which the moves go on from the communities found; connected
pieces; on the first level, vertices of small communities join their strongest neighbour. Clusters are the next level's vertices.

Moves go in rounds: in each, the half of the vertices that a bit of their digest names may move at once to the neighbouring
cluster of greatest gain, ties to the greatest name, until none wants to. A round is a few sums and a maximum, so it gives the
same whether a repository is an array in one task or a table: repositories up to `cap` edges are bundled and solved in tasks,
larger ones by joins, with equal results at any cap.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import fresh_path, remove, written, written_at

LEVELS = "repo string, level int, fqn string, cluster string"
#: Rounds of moves at most. Two neighbours that both may move can go round each other for ever.
ROUNDS = 40


def _digest(name: str) -> int:
    """As xxhash64 of a string column."""
    x = xxhash.xxh64_intdigest(name.encode(), 42)
    return x - (1 << 64) if x >= 1 << 63 else x


# ---- in one task: vertices are numbered in order of their names ----


def _sums(v: np.ndarray, c: np.ndarray, w: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    key, at = np.unique(v * n + c, return_inverse=True)
    return key // n, key % n, np.bincount(at.ravel(), w, minlength=len(key))


def _moves(arcs: tuple, k: np.ndarray, two_m: float, digest: np.ndarray, start: np.ndarray, gamma: float, within: np.ndarray | None = None) -> np.ndarray:
    v, u, w = arcs
    n, own = len(k), start.copy()
    if within is not None:
        same = within[v] == within[u]
        v, u, w = v[same], u[same], w[same]
    for r in range(ROUNDS):
        total = np.bincount(own, k, minlength=n)
        vv, cc, ww = _sums(v, own[u], w, n)
        mine = cc == own[vv]
        gain = ww - gamma * k[vv] * (total[cc] - np.where(mine, k[vv], 0.0)) / two_m
        stay = 0.0 - gamma * k * (total[own] - k) / two_m
        stay[vv[mine]] = gain[mine]
        order = np.lexsort((cc, gain, vv))
        last = order[np.append(np.flatnonzero(np.diff(vv[order])), len(order) - 1)] if len(order) else order
        wants = gain[last] > stay[vv[last]]
        if not wants.any():
            break
        go = last[wants & ((digest[vv[last]] >> (r % 60)) & 1 == 0)]
        own[vv[go]] = cc[go]
    return own


def _pieces(arcs: tuple, part: np.ndarray) -> np.ndarray:
    """Each vertex with the first vertex of its connected piece of its part."""
    v, u, _ = arcs
    inner = part[v] == part[u]
    v, u = v[inner], u[inner]
    low = np.arange(len(part))
    while True:
        new = low.copy()
        np.minimum.at(new, v, low[u])
        new = new[new]
        if (new == low).all():
            return low
        low = new


def _merge_small(arcs: tuple, part: np.ndarray, least: int) -> np.ndarray:
    """Vertices of parts below `least` join the neighbouring part, not small itself, that they are tied to most, ties to the first
    name; again with those that have joined, until none can."""
    v, u, w = arcs
    n, part = len(part), part.copy()
    small = np.bincount(part, minlength=n)[part] < least
    while True:
        can = small[v] & ~small[u]
        vv, cc, ww = _sums(v[can], part[u[can]], w[can], n)
        if not len(vv):
            return part
        order = np.lexsort((-cc, ww, vv))
        last = order[np.append(np.flatnonzero(np.diff(vv[order])), len(order) - 1)]
        part[vv[last]] = cc[last]
        small[vv[last]] = False


def _contracted(arcs: tuple, part: np.ndarray, n: int) -> tuple:
    v, u, w = arcs
    a, b, s = _sums(part[v], part[u], w, n)
    keep = a != b
    return a[keep], b[keep], s[keep]


def hierarchy_of(names: list[str], pairs: list[tuple[int, int, float]], gamma: float = 1.0, least: int = 3, levels: int = 3) -> list[list[int]]:
    """Per level, the cluster of each vertex, named by its first vertex. names are in order and distinct. Stops when a level has
    one cluster or is not coarser."""
    n = len(names)
    p = np.array([(a, b) for a, b, _ in pairs], np.int64).reshape(-1, 2)
    w = np.array([x for _, _, x in pairs], float)
    arcs = (np.concatenate([p[:, 0], p[:, 1]]), np.concatenate([p[:, 1], p[:, 0]]), np.concatenate([w, w]))
    digest = np.array([_digest(x) for x in names], np.int64)
    alive, lift, out = np.arange(n), np.arange(n), []
    for level in range(levels):
        k = np.bincount(arcs[0], arcs[2], minlength=n)
        two_m = float(k.sum()) or 1.0
        each = np.arange(n)
        found = _moves(arcs, k, two_m, digest, each, gamma)
        fine = _moves(arcs, k, two_m, digest, each, gamma, within=found)
        start = each.copy()
        start[fine] = found  # a refined part lies in one community
        of_part = np.bincount(fine, k, minlength=n)
        part = _moves(_contracted(arcs, fine, n), of_part, two_m, digest, start, gamma)[fine]
        part = _pieces(arcs, part)
        if level == 0:
            part = _merge_small(arcs, part, least)
        first = np.full(n, n)
        np.minimum.at(first, part[alive], alive)
        part = np.where(np.isin(each, alive), first[part], each)
        kept = np.unique(part[alive])
        if level and len(kept) >= len(alive):
            break
        lift = part[lift]
        out.append(lift.tolist())
        if len(kept) <= 1:
            break
        arcs, alive = _contracted(arcs, part, n), kept
    return out


def _solve(pdf: pd.DataFrame) -> pd.DataFrame:
    rows = []
    for repo, g in pdf.groupby("repo", dropna=False):
        names = sorted({*g["a"], *g["b"]})
        at = {v: i for i, v in enumerate(names)}
        pairs = [(at[a], at[b], float(w)) for a, b, w in zip(g["a"], g["b"], g["weight"])]
        for level, part in enumerate(hierarchy_of(names, pairs)):
            rows += [(None if pd.isna(repo) else repo, level, v, names[p]) for v, p in zip(names, part)]
    return pd.DataFrame(rows, columns=["repo", "level", "fqn", "cluster"])


# ---- by joins: r is the repository's key, names stay as they are ----


def _table_moves(arcs: DataFrame, vertices: DataFrame, gamma: float, within: DataFrame | None = None) -> DataFrame:
    """(r, v, cluster) for arcs (r, v, u, w) and vertices (r, v, k, two_m, h, cluster)."""
    spark = arcs.sparkSession
    if within is not None:
        a, b = (within.select("r", F.col("v").alias(x), F.col("cluster").alias(f"in_{x}")) for x in ("v", "u"))
        arcs = written(arcs.join(a, ["r", "v"]).join(b, ["r", "u"]).where("in_v = in_u").select("r", "v", "u", "w"), "inner_arcs")
    path = fresh_path(spark, "moves")
    state = written_at(vertices.select("r", "v", "k", "two_m", "h", "cluster"), path)
    for i in range(ROUNDS):
        tie = arcs.join(state.select("r", F.col("v").alias("u"), "cluster"), ["r", "u"]).groupBy("r", "v", "cluster").agg(F.sum("w").alias("w"))
        total = state.groupBy("r", "cluster").agg(F.sum("k").alias("total"))
        me = state.select("r", "v", "k", "two_m", F.col("cluster").alias("own"))
        g = tie.join(total, ["r", "cluster"]).join(me, ["r", "v"])
        inside = F.col("total") - F.when(F.col("cluster") == F.col("own"), F.col("k")).otherwise(F.lit(0.0))
        g = g.withColumn("gain", F.col("w") - F.lit(gamma) * F.col("k") * inside / F.col("two_m"))
        best = g.groupBy("r", "v").agg(F.max(F.struct("gain", "cluster")).alias("best"), F.max(F.when(F.col("cluster") == F.col("own"), F.col("gain"))).alias("stay"))
        here = state.join(total, ["r", "cluster"]).join(best, ["r", "v"], "left")
        alone = F.lit(0.0) - F.lit(gamma) * F.col("k") * (F.col("total") - F.col("k")) / F.col("two_m")
        wants = F.coalesce(F.col("best.gain") > F.coalesce("stay", alone), F.lit(False))
        may = F.shiftright("h", i % 60).bitwiseAND(F.lit(1)) == 0
        new_path = fresh_path(spark, "moves")
        out = written_at(here.select("r", "v", "k", "two_m", "h", F.when(wants & may, F.col("best.cluster")).otherwise(F.col("cluster")).alias("cluster"), wants.alias("wants")), new_path)
        remove(spark, path)
        path, state = new_path, out.drop("wants")
        if not out.where("wants").limit(1).count():
            break
    return state.select("r", "v", "cluster")


def _table_pieces(arcs: DataFrame, part: DataFrame) -> DataFrame:
    """part (r, v, cluster) with each cluster's connected pieces as clusters, by the least name."""
    a, b = (part.select("r", F.col("v").alias(x), F.col("cluster").alias(f"in_{x}")) for x in ("v", "u"))
    inner = written(arcs.join(a, ["r", "v"]).join(b, ["r", "u"]).where("in_v = in_u").select("r", "v", "u"), "inner_arcs")
    low = written(part.select("r", "v", F.col("v").alias("low")), "low")
    while True:
        near = inner.join(low.select("r", F.col("v").alias("u"), F.col("low").alias("u_low")), ["r", "u"]).groupBy("r", "v").agg(F.min("u_low").alias("near"))
        new = low.join(near, ["r", "v"], "left").select("r", "v", "low", F.least("low", "near").alias("new"))
        jump = new.select("r", F.col("v").alias("new"), F.col("new").alias("jumped"))
        new = written(new.join(jump, ["r", "new"]).select("r", "v", "low", F.col("jumped").alias("new")), "low")
        if not new.where("new <> low").limit(1).count():
            return low.select("r", "v", F.col("low").alias("cluster"))
        low = new.select("r", "v", F.col("new").alias("low"))


def _table_merge_small(arcs: DataFrame, part: DataFrame, least: int) -> DataFrame:
    size = part.groupBy("r", "cluster").agg((F.count("*") < least).alias("small"))
    state = written(part.join(size, ["r", "cluster"]).select("r", "v", "cluster", "small"), "small")
    while state.where("small").limit(1).count():
        mine = state.where("small").select("r", "v")
        near = arcs.join(mine, ["r", "v"], "left_semi").join(state.where("not small").select("r", F.col("v").alias("u"), "cluster"), ["r", "u"])
        tie = near.groupBy("r", "v", "cluster").agg(F.sum("w").alias("w"))
        most = tie.groupBy("r", "v").agg(F.max("w").alias("w"))
        join = written(tie.join(most, ["r", "v", "w"]).groupBy("r", "v").agg(F.min("cluster").alias("to")), "joining")
        if not join.limit(1).count():
            break
        state = written(state.join(join, ["r", "v"], "left").select("r", "v", F.coalesce("to", "cluster").alias("cluster"), (F.col("small") & F.col("to").isNull()).alias("small")), "small")
    return state.select("r", "v", "cluster")


def _table_contracted(arcs: DataFrame, part: DataFrame) -> DataFrame:
    a, b = (part.select("r", F.col("v").alias(x), F.col("cluster").alias(f"in_{x}")) for x in ("v", "u"))
    e = arcs.join(a, ["r", "v"]).join(b, ["r", "u"]).where("in_v <> in_u")
    return e.groupBy("r", F.col("in_v").alias("v"), F.col("in_u").alias("u")).agg(F.sum("w").alias("w"))


def _by_tables(graph: DataFrame, gamma: float, least: int, levels: int) -> DataFrame:
    """(r, level, v, cluster) for graph (r, a, b, weight): `hierarchy_of` for all repositories at once."""
    one = graph.select("r", F.col("a").alias("v"), F.col("b").alias("u"), F.col("weight").alias("w"))
    arcs = written(one.unionByName(one.select("r", F.col("u").alias("v"), F.col("v").alias("u"), "w")), "arcs")
    alive = arcs.select("r", "v").distinct()
    lift, out = None, None
    for level in range(levels):
        k = arcs.groupBy("r", "v").agg(F.sum("w").alias("k"))
        m = arcs.groupBy("r").agg(F.sum("w").alias("two_m"))
        every = alive.join(k, ["r", "v"], "left").join(m, "r", "left")
        vertices = written(every.select("r", "v", F.coalesce("k", F.lit(0.0)).alias("k"), F.coalesce("two_m", F.lit(1.0)).alias("two_m"), F.xxhash64("v").alias("h"), F.col("v").alias("cluster")), "vertices")
        found = written(_table_moves(arcs, vertices, gamma), "found")
        fine = written(_table_moves(arcs, vertices, gamma, within=found), "fine")
        of = fine.select("r", "v", F.col("cluster").alias("part")).join(found, ["r", "v"]).join(vertices.drop("cluster", "h"), ["r", "v"])
        parts = of.groupBy("r", F.col("part").alias("v")).agg(F.sum("k").alias("k"), F.first("two_m").alias("two_m"), F.first("cluster").alias("cluster"))
        moved = _table_moves(written(_table_contracted(arcs, fine), "part_arcs"), parts.withColumn("h", F.xxhash64("v")), gamma)
        part = fine.select("r", "v", F.col("cluster").alias("part")).join(moved.select("r", F.col("v").alias("part"), "cluster"), ["r", "part"]).select("r", "v", "cluster")
        part = _table_pieces(arcs, written(part, "part"))
        if level == 0:
            part = _table_merge_small(arcs, part, least)
        first = part.groupBy("r", "cluster").agg(F.min("v").alias("name"))
        part = written(part.join(first, ["r", "cluster"]).select("r", "v", F.col("name").alias("cluster")), "level")
        # a repository that this level makes no coarser ends with the level before, one of one cluster with this
        size = part.groupBy("r").agg(F.count("*").alias("n"), F.countDistinct("cluster").alias("n_clusters")).where("n_clusters < n" if level else "true")
        part = written(part.join(size.select("r", "n_clusters"), "r"), "part")
        step = part.select("r", "v", "cluster")
        lift = step if lift is None else written(lift.select("r", F.col("v").alias("x"), F.col("cluster").alias("v")).join(step, ["r", "v"]).select("r", F.col("x").alias("v"), "cluster"), "lift")
        rows = lift.select("r", F.lit(level).alias("level"), "v", "cluster")
        out = rows if out is None else out.unionByName(rows)
        on = part.where("n_clusters > 1")
        alive = written(on.select("r", F.col("cluster").alias("v")).distinct(), "alive")
        if not alive.limit(1).count():
            break
        arcs = written(_table_contracted(arcs, on), "arcs")
    return out


def communities(graph: DataFrame, cap: int = 500_000, bundle_edges: int = 100_000, gamma: float = 1.0, least: int = 3, levels: int = 3) -> DataFrame:
    """`LEVELS` for graph (repo, a, b, weight), a < b, weights whole numbers; a cluster is named by its first member. A null
    repository is one of its own. Repositories above `cap` edges are solved by joins, with the same result."""
    key = F.coalesce(F.concat(F.lit("+"), "repo"), F.lit("-")).alias("r")
    graph = written(graph.select("repo", key, "a", "b", F.col("weight").cast("double").alias("weight")), "graph")
    size = written(graph.groupBy("r").count(), "sizes")
    n, most = size.agg(F.sum("count"), F.max("count")).first()
    if not n:
        return graph.sparkSession.createDataFrame([], LEVELS)
    big = size.where(F.col("count") > cap).select("r")
    near = graph.join(big, "r", "left_anti") if most > cap else graph
    bundle = F.pmod(F.xxhash64("r"), F.lit(max(1, n // bundle_edges))).alias("bundle")
    out = near.select(bundle, "repo", "a", "b", "weight").groupBy("bundle").applyInPandas(lambda pdf: _solve(pdf), LEVELS)
    if most > cap:
        far = _by_tables(written(graph.join(big, "r", "left_semi").select("r", "a", "b", "weight"), "far"), gamma, least, levels)
        out = out.unionByName(far.select(F.when(F.col("r") != "-", F.substring("r", 2, 1 << 30)).alias("repo"), "level", F.col("v").alias("fqn"), "cluster"))
    return out


def parents(levels: DataFrame) -> DataFrame:
    """(repo, level, cluster, parent): each cluster with the one of the next level that holds its members."""
    up = levels.select(F.col("repo").alias("u_repo"), (F.col("level") - 1).alias("u_level"), F.col("fqn").alias("u_fqn"), F.col("cluster").alias("parent"))
    on = levels.repo.eqNullSafe(up.u_repo) & (levels.level == up.u_level) & (levels.fqn == up.u_fqn)
    return levels.join(up, on, "left").groupBy("repo", "level", "cluster").agg(F.min("parent").alias("parent"), F.count("*").alias("member_count"))
