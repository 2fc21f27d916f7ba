"""Parent-child rows to full hierarchies.

1. Components. A node has at most one parent, so a component has exactly one top (a root, or a node
   whose parent is missing) or exactly one loop. Pointer doubling finds it in log2(longest chain)
   rounds; every round is one hash join and is written to the shared folder.
2. Components up to `component_cap` nodes and `element_cap` places in their paths, known from the
   depths that the doubling counts, are co-located, many to a bundle of about `bundle_rows` rows,
   and traversed depth-first with node colours (white, grey, black). A grey node met again closes
   a loop: that edge is the back edge.
3. A component above a cap never enters one task: its paths come from doubling path segments,
   which is exact as well, only with more shuffles.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.session import fresh_path, remove, written, written_at

HIERARCHY_SCHEMA = (
    "id bigint, parent_id bigint, outcome string, root_id bigint, depth int, path array<bigint>, "
    "n_descendants bigint, cycle_id bigint, is_back_edge boolean"
)


def current_links(df: DataFrame, node_id: str, parent: str, version: str, none_values: tuple = (0,)) -> DataFrame:
    """One row per id: that with the greatest version (ties: the greatest parent). Rows with a null id have no identity and
    are left out; a null parent or one of `none_values` means that there is none. Other columns are ignored."""
    p = F.when(~F.col(parent).isin(*none_values), F.col(parent)).cast("bigint")
    return (
        df.where(F.col(node_id).isNotNull())
        .select(F.col(node_id).cast("bigint").alias("id"), F.struct(F.col(version).alias("v"), p.alias("p")).alias("r"))
        .groupBy("id")
        .agg(F.max("r").alias("r"))
        .select("id", F.col("r.p").alias("parent_id"))
    )


def components(links: DataFrame) -> DataFrame:
    """(id, parent_id, top, kind, component, depth): kind is `root`, `lost` or `loop`; top is the node at which the chain ends, for
    a loop some node on it. component is the same for all nodes of a component. depth counts the links to the top, 0 for loops."""
    spark = links.sparkSession
    ids = links.select(F.col("id").alias("p_id"))
    linked = links.join(ids, links.parent_id == ids.p_id, "left")
    base = written(
        linked.select(
            "id",
            "parent_id",
            F.when(F.col("parent_id").isNull(), "root").when(F.col("p_id").isNull(), "lost").alias("kind"),
        ),
        "links",
    )
    state = base.select("id", F.when(F.col("kind").isNull(), F.col("parent_id")).otherwise(F.col("id")).alias("ptr"), "kind", F.col("id").alias("low"), F.when(F.col("kind").isNull(), 1).otherwise(0).cast("bigint").alias("dist"))

    def jump(s: DataFrame) -> DataFrame:
        t = s.select(F.col("id").alias("t_id"), F.col("ptr").alias("t_ptr"), F.col("kind").alias("t_kind"), F.col("low").alias("t_low"), F.col("dist").alias("t_dist"))
        moved = s.where(F.col("kind").isNull()).join(t, F.col("ptr") == F.col("t_id"))
        moved = moved.select("id", F.col("t_ptr").alias("ptr"), F.col("t_kind").alias("kind"), F.least("low", "t_low").alias("low"), (F.col("dist") + F.col("t_dist")).alias("dist"))
        return s.where(F.col("kind").isNotNull()).unionByName(moved)

    before, steps, left_before = None, 1, -1
    while True:
        path = fresh_path(spark, "pointers")
        state = written_at(jump(jump(state)), path)
        if before:
            remove(spark, before)
        before, steps = path, steps * 4
        left = state.where(F.col("kind").isNull()).count()
        # no pointer of an open row ends at a top any more: all open rows run into loops, and after as many
        # steps as there are open rows each pointer stands on its loop and `low` has seen the whole loop
        if left == 0 or (left == left_before and steps >= left):
            break
        left_before = left
    loops = state.where(F.col("kind").isNull())
    # after a whole turn the pointers of open rows are exactly the nodes on loops, each with the least id of its loop as `low`
    on_loop = loops.select(F.col("ptr").alias("loop_id")).distinct()
    on_loop = on_loop.join(loops.select(F.col("id").alias("loop_id"), F.col("low").alias("loop_low")), "loop_id")
    marked = state.join(on_loop, (state.ptr == on_loop.loop_id) & state.kind.isNull(), "left")
    marked = marked.select(
        "id", F.coalesce("kind", F.lit("loop")).alias("kind"), F.col("ptr").alias("top"), F.coalesce("loop_low", "ptr").alias("component"), F.when(F.col("kind").isNull(), 0).otherwise(F.col("dist")).alias("depth")
    )
    return base.drop("kind").join(marked, "id")


def _walk(pdf: pd.DataFrame, with_paths: bool = True) -> pd.DataFrame:
    """Depth-first traversal of whole components. White 0, grey 1, black 2. Without paths they are null, and a chain of any length
    takes room for its nodes only."""
    ids = pdf["id"].to_numpy(np.int64)
    order = np.argsort(ids)
    ids, parents, kinds = ids[order], pdf["parent_id"].to_numpy()[order], pdf["kind"].to_numpy()[order]
    n = len(ids)
    up = np.full(n, -1, np.int64)
    has = ~pd.isna(parents)
    want = parents[has].astype(np.int64)
    at = np.minimum(np.searchsorted(ids, want), n - 1)
    up[has] = np.where(ids[at] == want, at, -1)
    children: list[list[int]] = [[] for _ in range(n)]
    for i in range(n):
        if up[i] >= 0:
            children[up[i]].append(i)
    colour = np.zeros(n, np.int8)
    outcome: list = [None] * n
    root, depth, paths, below = [None] * n, [None] * n, [None] * n, [0] * n
    cycle, back = [None] * n, [False] * n
    for top in np.flatnonzero(up < 0):
        kind = "root" if kinds[top] == "root" else "lost_parent"
        stack, trail = [(int(top), 0)], []
        colour[top] = 1
        trail.append(int(ids[top]))
        if with_paths:
            paths[top] = list(trail)
        while stack:
            v, k = stack[-1]
            if k == 0:
                outcome[v], depth[v] = kind, len(trail) - 1
                root[v] = int(ids[top]) if kind == "root" else None
            if k < len(children[v]):
                stack[-1] = (v, k + 1)
                c = children[v][k]
                colour[c] = 1
                trail.append(int(ids[c]))
                if with_paths:
                    paths[c] = list(trail)
                stack.append((c, 0))
            else:
                colour[v] = 2
                stack.pop()
                trail.pop()
                if stack:
                    below[stack[-1][0]] += below[v] + 1
    # what is still white hangs on a loop; the walk goes from child to parent, least id first
    for start in range(n):
        if colour[start]:
            continue
        walk, v = [], start
        while colour[v] == 0:
            colour[v] = 1
            walk.append(v)
            v = int(up[v])
        if colour[v] == 1:  # grey again: the edge that led here closes a loop
            ring = walk[walk.index(v) :]
            low = min(ring)
            for w in ring:
                outcome[w], cycle[w], back[w] = "cycle", int(ids[low]), int(up[w]) == low
        for w in reversed(walk):
            colour[w] = 2
            if outcome[w] is None:
                outcome[w], cycle[w] = "under_cycle", cycle[int(up[w])]
    return pd.DataFrame(
        {
            "id": ids,
            "parent_id": pd.array([None if pd.isna(p) else int(p) for p in parents], dtype="Int64"),
            "outcome": outcome,
            "root_id": pd.array(root, dtype="Int64"),
            "depth": pd.array(depth, dtype="Int32"),
            "path": paths,
            "n_descendants": pd.array([b if d is not None else None for b, d in zip(below, depth)], dtype="Int64"),
            "cycle_id": pd.array(cycle, dtype="Int64"),
            "is_back_edge": back,
        }
    )


def _by_doubling(part: DataFrame) -> DataFrame:
    """The same columns for components above the cap, without gathering any of them."""
    spark = part.sparkSession
    trees = part.where("kind <> 'loop'").select(
        "id", "parent_id", "kind", "top", F.when(F.col("id") != F.col("top"), F.col("parent_id")).alias("ptr"), F.array("id").alias("path")
    )
    before = fresh_path(spark, "paths")
    state = written_at(trees, before)
    while state.where("ptr is not null").limit(1).count():
        t = state.select(F.col("id").alias("t_id"), F.col("ptr").alias("t_ptr"), F.col("path").alias("t_path"))
        moved = state.where("ptr is not null").join(t, F.col("ptr") == F.col("t_id"))
        moved = moved.select("id", "parent_id", "kind", "top", F.col("t_ptr").alias("ptr"), F.concat("t_path", "path").alias("path"))
        path = fresh_path(spark, "paths")
        state = written_at(state.where("ptr is null").unionByName(moved), path)
        remove(spark, before)
        before = path
    below = state.select(F.explode("path").alias("id")).groupBy("id").agg((F.count("*") - 1).alias("n_descendants"))
    is_root = F.col("kind") == "root"
    tree_rows = state.join(below, "id").select(
        "id",
        "parent_id",
        F.when(is_root, "root").otherwise("lost_parent").alias("outcome"),
        F.when(is_root, F.col("top")).alias("root_id"),
        (F.size("path") - 1).alias("depth"),
        "path",
        "n_descendants",
        F.lit(None).cast("bigint").alias("cycle_id"),
        F.lit(False).alias("is_back_edge"),
    )
    loops = part.where("kind = 'loop'")
    ring = loops.select(F.col("top").alias("ring_id")).distinct()
    on = F.col("ring_id").isNotNull()
    loop_rows = loops.join(ring, loops.id == ring.ring_id, "left").select(
        "id",
        "parent_id",
        F.when(on, "cycle").otherwise("under_cycle").alias("outcome"),
        F.lit(None).cast("bigint").alias("root_id"),
        F.lit(None).cast("int").alias("depth"),
        F.lit(None).cast("array<bigint>").alias("path"),
        F.lit(None).cast("bigint").alias("n_descendants"),
        F.col("component").alias("cycle_id"),
        (on & (F.col("parent_id") == F.col("component"))).alias("is_back_edge"),
    )
    return tree_rows.unionByName(loop_rows)


def _bundles(comps: DataFrame, bundle_rows: int, with_paths: bool) -> DataFrame:
    bundle: Column = F.pmod(F.xxhash64("component"), F.lit(max(1, -(-comps.count() // bundle_rows)))).alias("bundle")
    return comps.select("id", "parent_id", "kind", bundle).groupBy("bundle").applyInPandas(lambda pdf: _walk(pdf, with_paths), HIERARCHY_SCHEMA)


def _apart(comps: DataFrame, too_big: Column) -> tuple[DataFrame, DataFrame | None]:
    """Components that fit one task, and the rows of those that do not."""
    sizes = comps.groupBy("component").agg(F.count("*").alias("n"), F.sum(F.col("depth") + 1).alias("n_places"))
    big = written(sizes.where(too_big).select(F.col("component").alias("big")), "big")
    if not big.limit(1).count():
        return comps, None
    return comps.join(big, comps.component == big.big, "left_anti"), comps.join(big, comps.component == big.big, "left_semi")


def hierarchies(links: DataFrame, component_cap: int = 200_000, bundle_rows: int = 50_000, element_cap: int = 5_000_000) -> DataFrame:
    """`HIERARCHY_SCHEMA` for links (id, parent_id), one row per id as `current_links` gives.

    outcome: `root` (the chain ends at a root), `lost_parent`, `cycle` (on a loop, a node may be its own parent) or
    `under_cycle`. path goes from the top to the node, both included; for lost_parent the top is the last node that exists
    and root_id is null. On and under loops root_id, depth, path and n_descendants are null and cycle_id is the least id of
    the loop; is_back_edge marks the one edge per loop that leads back to that id. An empty table gives no rows.
    """
    comps = written(components(links), "components")
    near, far = _apart(comps, (F.col("n") > component_cap) | (F.col("n_places") > element_cap))
    done = _bundles(near, bundle_rows, True)
    return done.unionByName(_by_doubling(written(far, "far"))) if far is not None else done


def outcomes(links: DataFrame, component_cap: int = 1_000_000, bundle_rows: int = 200_000) -> DataFrame:
    """(id, parent_id, outcome, cycle_id, is_back_edge) as `hierarchies` gives, without paths, so that depth costs nothing."""
    columns = ["id", "parent_id", "outcome", "cycle_id", "is_back_edge"]
    comps = written(components(links), "components")
    near, far = _apart(comps, F.col("n") > component_cap)
    done = _bundles(near, bundle_rows, False).select(*columns)
    if far is None:
        return done
    ring = far.where("kind = 'loop'").select(F.col("top").alias("ring_id")).distinct()
    on = F.col("ring_id").isNotNull()
    kind = F.when(F.col("kind") == "root", "root").when(F.col("kind") == "lost", "lost_parent").when(on, "cycle").otherwise("under_cycle")
    rows = far.join(ring, far.id == ring.ring_id, "left")
    return done.unionByName(rows.select("id", "parent_id", kind.alias("outcome"), F.when(F.col("kind") == "loop", F.col("component")).alias("cycle_id"), (on & (F.col("parent_id") == F.col("component"))).alias("is_back_edge")))


def descendants(tree: DataFrame) -> DataFrame:
    """(ancestor_id, descendant_id, distance) for every node under a top, the node itself excluded: one row per pair, so that
    no node's descendants are ever gathered in one row or task."""
    pairs = tree.where("path is not null").select(F.col("id").alias("descendant_id"), "depth", F.posexplode("path").alias("at", "ancestor_id"))
    return pairs.where("at < depth").select("ancestor_id", "descendant_id", (F.col("depth") - F.col("at")).cast("int").alias("distance"))


def loop_hierarchies(tree: DataFrame, component_cap: int = 200_000, bundle_rows: int = 50_000) -> DataFrame:
    """`HIERARCHY_SCHEMA` for the nodes of tree on and under loops, each loop cut at its back edge: the node that the edge leaves
    is the top, path, depth and n_descendants count from there. root_id is null; outcome, cycle_id and is_back_edge stay."""
    loops = written(tree.where("cycle_id is not null").select("id", "parent_id", "outcome", "root_id", "cycle_id", "is_back_edge"), "loops")
    cut = hierarchies(loops.select("id", F.when(~F.col("is_back_edge"), F.col("parent_id")).alias("parent_id")), component_cap, bundle_rows)
    return loops.join(cut.select("id", "depth", "path", "n_descendants"), "id").select("id", "parent_id", "outcome", "root_id", "depth", "path", "n_descendants", "cycle_id", "is_back_edge")
