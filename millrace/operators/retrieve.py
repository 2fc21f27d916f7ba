"""Retrieval plans over ranked lists: fusion, hydration, reranking, the three routes and their dispatch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions.scalars import leaf, symbol_in
from millrace.operators.graph import callers, suffix_lookup


def fuse(dense: DataFrame, sparse: DataFrame, k: int = 60) -> DataFrame:
    """(query_id, item, score, rank) of two ranked lists (query_id, item, rank) by reciprocal ranks; equal scores keep dense
    rank first, then sparse-only rank."""
    both = dense.select("query_id", "item", "rank", F.lit(0).alias("side")).unionByName(sparse.select("query_id", "item", "rank", F.lit(1).alias("side")))
    g = both.groupBy("query_id", "item").agg(
        F.round(F.sum(1 / (F.lit(k) + F.col("rank"))), 9).alias("score"),
        F.coalesce(F.min(F.when(F.col("side") == 0, F.col("rank"))), F.min(F.col("rank") + 1_000_000)).alias("place"),
    )
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "place")
    return g.withColumn("rank", F.row_number().over(order)).drop("place")


def hydrate(ranked: DataFrame, chunks: DataFrame, n: int, repo: str | None = None) -> DataFrame:
    """The first n items with their chunks; the repository filter comes after the cut, and items without a chunk vanish."""
    top = ranked.where(F.col("rank") <= n)
    got = chunks.join(top, chunks.chunk_id == top.item)
    return got.where(F.col("repo") == repo) if repo is not None else got


def rerank(candidates: DataFrame, k: int) -> DataFrame:
    """Candidates (query_id, question, item, text, rank) by the number of distinct lower-case words shared with the question;
    ties keep the candidates' order."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"\s+"), lambda w: w != ""))
    shared = F.size(F.array_intersect(words(F.col("question")), words(F.col("text")))).alias("overlap")
    scored = candidates.select("*", shared)
    order = Window.partitionBy("query_id").orderBy(F.col("overlap").desc(), "rank")
    return scored.withColumn("new_rank", F.row_number().over(order)).where(F.col("new_rank") <= k)


def rerank_by(candidates: DataFrame, k: int, score) -> DataFrame:
    """Candidates (query_id, question, item, text, rank) by `score`, a function of the question's and the text's column, such as a
    pandas UDF over a cross-encoder; ties keep the candidates' order, null scores come last."""
    scored = candidates.withColumn("score", score(F.col("question"), F.col("text")).cast("double"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc_nulls_last(), "rank")
    return scored.withColumn("new_rank", F.row_number().over(order)).where(F.col("new_rank") <= k)


def hybrid(queries: DataFrame, dense: DataFrame, sparse: DataFrame, chunks: DataFrame, top_k: int = 8, cut: int = 20, reranking: bool = True, repo: str | None = None) -> DataFrame:
    """(query_id, rank, item, path, start_line, end_line, score): fusion, cut, hydration, reranking."""
    fused = fuse(dense, sparse)
    got = hydrate(fused, chunks, cut if reranking else top_k, repo)
    got = got.join(queries.select("query_id", "question"), "query_id").select("query_id", "question", "item", "text", "path", "start_line", "end_line", "rank", "score")
    if reranking:
        return rerank(got, top_k).select("query_id", F.col("new_rank").alias("rank"), "item", "path", "start_line", "end_line", F.col("overlap").cast("double").alias("score"))
    return got.select("query_id", "rank", "item", "path", "start_line", "end_line", "score")


#: Phrases of the graph route's answers (fixed values).
NO_CALLERS, NO_SYMBOL = " has no recorded callers.", "No symbol matching '"


def graph_lines(questions: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(query_id, symbol, fqn, src_path, src_line, caller, line): what the graph says to each question, a row for each line of the
    answer, so that a symbol that everything calls fills no row of its own. Each symbol that the question's name matches comes
    first, with nulls for the caller, then its callers; fqn is null where nothing matches. Repeated calls count once."""
    asked = questions.select("query_id", symbol_in(F.col("question")).alias("symbol"))
    named = suffix_lookup(asked.where("symbol is not null"), nodes)
    calls = edges.where("kind = 'call'").groupBy("src", "dst", "src_line").agg(F.min("src_path").alias("src_path")).withColumn("kind", F.lit("call"))
    found = callers(named, calls).select("query_id", "fqn", "caller", "src_path", "src_line")
    at = F.concat(F.lit("    - "), "caller", F.lit(" at ["), F.coalesce("src_path", F.lit("")), F.lit(":"), F.col("src_line").cast("string"), F.lit("-"), F.col("src_line").cast("string"), F.lit("]"))
    heads = found.groupBy("query_id", "fqn").agg(F.count("caller").alias("n"))
    head = F.concat(F.lit("- "), "fqn", F.when(F.col("n") == 0, NO_CALLERS).otherwise(":"))
    none = lambda kind: F.lit(None).cast(kind)
    rows = heads.select("query_id", "fqn", none("string").alias("src_path"), none("int").alias("src_line"), none("string").alias("caller"), head.alias("line"))
    rows = rows.unionByName(found.where("caller is not null").select("query_id", "fqn", "src_path", F.col("src_line").cast("int").alias("src_line"), "caller", at.alias("line")))
    missing = F.concat(F.lit(NO_SYMBOL), F.coalesce("symbol", F.lit("")), F.lit("' in the index."))
    return asked.join(rows, "query_id", "left").select("query_id", "symbol", "fqn", "src_path", "src_line", "caller", F.coalesce("line", missing).alias("line"))


def graph_route(questions: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(query_id, symbol, answer, n_citations): `graph_lines` as one text a question, symbols in order of name, callers in order of
    their place."""
    rows = graph_lines(questions, nodes, edges)
    order = F.struct("fqn", F.col("caller").isNotNull().alias("below"), "src_path", "src_line", "caller", "line")
    per = rows.groupBy("query_id", "symbol").agg(F.array_sort(F.collect_list(order)).alias("ls"), F.count("caller").alias("n_citations"))
    return per.select("query_id", "symbol", F.array_join(F.transform("ls", lambda x: x.line), "\n").alias("answer"), "n_citations")


def community_chunks(hits: DataFrame, members: DataFrame, chunks: DataFrame, per_hit: int = 4) -> DataFrame:
    """(query_id, hit_rank, chunk_id, place): for hits (query_id, hit_rank, community_id) in order, up to `per_hit` chunks each of
    their members (seeds if there are any), longest first, none taken twice by one question.

    Each question folds over its few hits in order; a hit has at most 4 * per_hit candidates, so the fold is bounded.
    """
    seeded = members.groupBy("community_id").agg(F.max(F.col("is_seed").cast("int")).alias("any_seed"))
    m = members.join(seeded, "community_id").where((F.col("any_seed") == 0) | F.col("is_seed")).select("community_id", leaf(F.col("fqn")).alias("leaf")).distinct()
    c = chunks.where("symbol is not null").select("chunk_id", "symbol", "path", "start_line", (F.col("end_line") - F.col("start_line") + 1).alias("span")).dropDuplicates(["chunk_id"])
    cand = m.join(c, F.col("leaf") == F.col("symbol")).select("community_id", "chunk_id", "path", "start_line", "span").distinct()
    order = Window.partitionBy("community_id").orderBy(F.col("span").desc(), "path", "start_line", "chunk_id")
    cand = cand.withColumn("place", F.row_number().over(order)).where(F.col("place") <= 4 * per_hit)
    lists = cand.groupBy("community_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "chunk_id"))), lambda x: x.chunk_id).alias("ids"))
    per_q = hits.join(lists, "community_id").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("hit_rank", "ids"))).alias("hs"))
    start = F.array().cast("array<struct<hit_rank:int,chunk_id:string>>")

    def take(acc, h):
        fresh = F.slice(F.filter(h.ids, lambda i: ~F.exists(acc, lambda a: a.chunk_id == i)), 1, per_hit)
        return F.concat(acc, F.transform(fresh, lambda i: F.struct(h.hit_rank.cast("int").alias("hit_rank"), i.alias("chunk_id"))))

    taken = F.aggregate("hs", start, take)
    return per_q.select("query_id", F.posexplode(taken).alias("place", "t")).select("query_id", F.col("t.hit_rank").alias("hit_rank"), F.col("t.chunk_id").alias("chunk_id"), (F.col("place") + 1).alias("place"))


def route(questions: DataFrame) -> DataFrame:
    """(query_id, route, symbol, confidence, reason): questions that name a symbol go to the graph, unless a hint says
    otherwise; without a model all others are hybrid."""
    s = symbol_in(F.col("question"))
    hint = F.coalesce(F.col("route_hint"), F.lit("auto")) if "route_hint" in questions.columns else F.lit("auto")
    name = F.when(hint != "auto", hint).when(s.isNotNull(), "graph").otherwise("hybrid")
    return questions.select(
        "query_id",
        name.alias("route"),
        s.alias("symbol"),
        F.when(hint != "auto", 1.0).when(s.isNotNull(), 0.9).otherwise(0.5).alias("confidence"),
        F.when(hint != "auto", "hint").when(s.isNotNull(), "symbol").otherwise("default").alias("reason"),
    )


def expand_hops(hits: DataFrame, edges: DataFrame, hops: int = 1, kinds: tuple[str, ...] = ("call", "inherit")) -> DataFrame:
    """(query_id, fqn, hop): names within `hops` edges, in either direction, of (query_id, fqn); the fewest hops count."""
    e = edges.where(F.col("kind").isin(*kinds)).select("src", "dst").distinct()
    arcs = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    out = hits.select("query_id", "fqn", F.lit(0).alias("hop")).distinct()
    edge = out
    for h in range(1, hops + 1):
        edge = edge.join(arcs, F.col("fqn") == F.col("src")).select("query_id", F.col("dst").alias("fqn"), F.lit(h).alias("hop")).distinct()
        edge = edge.join(out.select("query_id", "fqn"), ["query_id", "fqn"], "left_anti")
        out = out.unionByName(edge)
    return out
