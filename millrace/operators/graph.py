"""Symbol graph: look-ups, adjacency, resolution joins, subgraphs and contraction, for whole batches of questions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions.scalars import is_unresolved, leaf, parent


def suffix_lookup(asked: DataFrame, nodes: DataFrame, limit: int = 32) -> DataFrame:
    """(query_id, fqn): the first `limit` names, in order, that equal the symbol or end in `.symbol` (that without regard to
    case). asked (query_id, symbol); null symbols match nothing.

    Every suffix of a name is a join key, so the look-up is one equi-join rather than a comparison of all pairs.
    """
    parts = F.split("fqn", r"\.")
    n = nodes.where("fqn is not null").select("fqn").distinct()
    tails = n.select("fqn", F.explode(F.sequence(F.lit(1), F.size(parts))).alias("k"), parts.alias("p"))
    tails = tails.select("fqn", F.lower(F.array_join(F.slice("p", F.col("k"), F.size("p")), ".")).alias("tail"), (F.col("k") == 1).alias("whole"))
    hit = asked.join(tails, F.lower("symbol") == F.col("tail")).where(~F.col("whole") | (F.col("symbol") == F.col("fqn")))
    order = Window.partitionBy("query_id").orderBy("fqn")
    return hit.select("query_id", "fqn").distinct().withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= limit).drop("rn")


def neighbours(asked: DataFrame, edges: DataFrame, kind: str | None, direction: str) -> DataFrame:
    """`asked` (query_id, fqn) with the edges that leave (`out`) or reach (`in`) each name."""
    if direction not in ("in", "out"):
        raise ValueError("direction is in or out")
    key, other = ("dst", "src") if direction == "in" else ("src", "dst")
    e = edges.where(F.col("kind") == kind) if kind else edges
    e = e.select(F.col(key).alias("e_key"), F.col(other).alias("other"), "kind", "src_path", "src_line", "weight")
    return asked.join(e, F.col("fqn") == F.col("e_key")).drop("e_key")


def callers(asked: DataFrame, edges: DataFrame) -> DataFrame:
    """The callers of each (query_id, fqn), with a row of nulls where none is recorded."""
    e = edges.where("kind = 'call'").select(F.col("dst").alias("e_dst"), F.col("src").alias("caller"), "src_path", "src_line")
    return asked.join(e, F.col("fqn") == F.col("e_dst"), "left").drop("e_dst")


def def_edges(nodes: DataFrame) -> DataFrame:
    """(src, dst): each name and the one that defines it, for parents that exist, over the whole table."""
    n = nodes.where("fqn is not null").select("fqn").distinct()
    p = n.select(F.col("fqn").alias("p_fqn"))
    return n.join(p, parent(F.col("fqn")) == F.col("p_fqn")).select(F.col("p_fqn").alias("src"), F.col("fqn").alias("dst"))


def in_degree(edges: DataFrame) -> DataFrame:
    return edges.where("kind = 'call'").groupBy("dst").agg(F.count("*").alias("in_degree"))


def symmetrise(edges: DataFrame, nodes: DataFrame, kinds: tuple[str, ...] = ("call", "inherit")) -> DataFrame:
    """(a, b, weight, n_rows), a < b: the undirected graph for clustering. Unresolved names, ends outside `nodes` and loops
    are dropped; weights of both directions and all kinds add up."""
    if not kinds:
        raise ValueError("no kinds of edges")
    n = nodes.where("fqn is not null").select("fqn").distinct()
    e = edges.where(F.col("kind").isin(*kinds) & (F.col("src") != F.col("dst")) & ~is_unresolved(F.col("src")) & ~is_unresolved(F.col("dst")))
    e = e.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), F.coalesce("weight", F.lit(1)).alias("weight"))
    e = e.groupBy("a", "b").agg(F.sum("weight").cast("bigint").alias("weight"), F.count("*").alias("n_rows"))
    e = e.join(n.select(F.col("fqn").alias("a")), "a", "left_semi")
    return e.join(n.select(F.col("fqn").alias("b")), "b", "left_semi").select("a", "b", "weight", "n_rows")


def subgraph_stats(edges: DataFrame, nodes: DataFrame, kinds: tuple[str, ...] = ("call", "inherit")) -> DataFrame:
    """One row: n_vertices, n_edges, n_dropped (unresolved or outside, loops apart), n_collapsed, n_isolated."""
    n = nodes.where("fqn is not null").select("fqn").distinct()
    s = n.select(F.col("fqn").alias("s_fqn"))
    d = n.select(F.col("fqn").alias("d_fqn"))
    raw = edges.where(F.col("kind").isin(*kinds)).join(s, F.col("src") == F.col("s_fqn"), "left").join(d, F.col("dst") == F.col("d_fqn"), "left")
    dropped = raw.agg(F.coalesce(F.sum((F.col("s_fqn").isNull() | F.col("d_fqn").isNull() | is_unresolved(F.col("src")) | is_unresolved(F.col("dst"))).cast("bigint")), F.lit(0)).alias("n_dropped"))
    g = symmetrise(edges, nodes, kinds)
    ends = g.select(F.explode(F.array("a", "b")).alias("v")).distinct().agg(F.count("*").alias("n_vertices"))
    size = g.agg(F.count("*").alias("n_edges"), F.coalesce(F.sum("n_rows") - F.count("*"), F.lit(0)).cast("bigint").alias("n_collapsed"))
    total = n.agg(F.count("*").alias("n_nodes"))
    # four tables of one row each
    one = ends.crossJoin(size).crossJoin(dropped).crossJoin(total)
    return one.select("n_vertices", "n_edges", "n_dropped", "n_collapsed", (F.col("n_nodes") - F.col("n_vertices")).alias("n_isolated"))


def contract(graph: DataFrame, membership: DataFrame) -> DataFrame:
    """(a, b, weight) between clusters of membership (v, cluster); loops dropped."""
    m1 = membership.select(F.col("v").alias("a"), F.col("cluster").alias("ca"))
    m2 = membership.select(F.col("v").alias("b"), F.col("cluster").alias("cb"))
    e = graph.join(m1, "a").join(m2, "b").where("ca <> cb")
    return e.groupBy(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).agg(F.sum("weight").alias("weight"))


def incident_weight(graph: DataFrame, membership: DataFrame) -> DataFrame:
    """(v, cluster, weight): how much each vertex is tied to each cluster, its own included."""
    both = graph.select(F.col("a").alias("v"), F.col("b").alias("u"), "weight").unionByName(graph.select(F.col("b").alias("v"), F.col("a").alias("u"), "weight"))
    m = membership.select(F.col("v").alias("u"), "cluster")
    return both.join(m, "u").groupBy("v", "cluster").agg(F.sum("weight").alias("weight"))


def import_ripple(touched: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(path): files that import a module defined in a touched file (path), the touched files themselves left out."""
    modules = nodes.where("kind = 'module'").join(touched.select("path").distinct(), "path", "left_semi").select(F.col("fqn").alias("m")).distinct()
    hit = edges.where("kind = 'import'").join(modules, F.col("dst") == F.col("m"), "left_semi").select(F.col("src_path").alias("path")).where("path is not null").distinct()
    return hit.join(touched.select("path").distinct(), "path", "left_anti")


def seed_members(members: DataFrame, edges: DataFrame, chunks: DataFrame, k: int = 12, by_leaf: bool = False) -> DataFrame:
    """(community_id, fqn, in_degree, chunk_lines, score, rank): the k best members by 3 * in-degree + lines / 10, ties by name.
    Chunk symbols are compared to full names, or with `by_leaf` to their last segment, as was meant."""
    lines = chunks.where("symbol is not null").groupBy(F.col("symbol").alias("c_symbol")).agg(F.max(F.col("end_line") - F.col("start_line") + 1).alias("chunk_lines"))
    deg = in_degree(edges)
    m = members.select("community_id", "fqn").distinct().join(deg, F.col("fqn") == F.col("dst"), "left").drop("dst")
    m = m.join(lines, (leaf(F.col("fqn")) if by_leaf else F.col("fqn")) == F.col("c_symbol"), "left")
    score = 3 * F.coalesce("in_degree", F.lit(0)) + F.coalesce("chunk_lines", F.lit(0)) / 10
    m = m.select("community_id", "fqn", F.coalesce("in_degree", F.lit(0)).alias("in_degree"), F.coalesce("chunk_lines", F.lit(0)).alias("chunk_lines"), score.cast("double").alias("score"))
    order = Window.partitionBy("community_id").orderBy(F.col("score").desc(), "fqn")
    return m.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def content_sha(members: DataFrame, nodes: DataFrame, file_sha: DataFrame) -> DataFrame:
    """(community_id, content_sha): sha256 over the ordered members and the ordered (path, sha) of their files."""
    n = nodes.where("fqn is not null").groupBy("fqn").agg(F.max(F.struct("repo", "path")).alias("r")).select("fqn", "r.repo", "r.path")
    rows = members.select("community_id", "fqn").distinct().join(n, "fqn", "left").join(file_sha.select("repo", "path", "file_sha"), ["repo", "path"], "left")
    name = F.concat(F.lit("\0fqn:"), "fqn")
    file = F.concat(F.lit("\0path:"), F.coalesce("path", F.lit("")), F.lit("\0sha:"), F.coalesce("file_sha", F.lit("")))
    g = rows.groupBy("community_id").agg(F.array_sort(F.collect_set(name)).alias("names"), F.array_sort(F.collect_set(file)).alias("files"))
    return g.select("community_id", F.sha2(F.concat(F.array_join("names", ""), F.array_join("files", "")), 256).alias("content_sha"))
