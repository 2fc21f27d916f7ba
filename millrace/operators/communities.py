"""Community tables: stable ids, seeds, summaries bottom-up, subtree sizes and their vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators import leiden
from millrace.operators.answer import Model
from millrace.operators.graph import content_sha, seed_members, symmetrise
from millrace.operators.tables import summary_cache
from millrace.session import written

PLACEHOLDER = "<auto-summary unavailable>"


def with_ids(clusters: DataFrame) -> DataFrame:
    """Clusters (repo, level, cluster, parent, member_count) with community_id and parent_id. An id is the hash of repository,
    level and name, so that a rebuild over equal members gives equal ids and no global order is needed."""
    ident = lambda level, name: F.xxhash64(F.coalesce("repo", F.lit("")), level, name)
    up = F.when(F.col("parent").isNotNull(), ident(F.col("level") + 1, F.col("parent")))
    return clusters.select("repo", "level", "cluster", ident(F.col("level"), F.col("cluster")).alias("community_id"), up.alias("parent_id"), "member_count")


def mark_seeds(members: DataFrame, seeds: DataFrame) -> DataFrame:
    """members (community_id, fqn) with is_seed."""
    s = seeds.select("community_id", "fqn", F.lit(True).alias("_s")).distinct()
    return members.join(s, ["community_id", "fqn"], "left").withColumn("is_seed", F.coalesce("_s", F.lit(False))).drop("_s")


def update_summaries(communities: DataFrame, new: DataFrame) -> DataFrame:
    """`communities` with title, summary, summary_model and summarized_at of `new` where it has the id."""
    cols = ["title", "summary", "summary_model", "summarized_at"]
    n = new.select("community_id", F.struct(*cols).alias("_n")).dropDuplicates(["community_id"])
    j = communities.join(n, "community_id", "left")
    return j.select(*[F.when(F.col("_n").isNotNull(), F.col(f"_n.{c}")).otherwise(F.col(c)).alias(c) if c in cols else F.col(c) for c in communities.columns])


def subtree_sizes(tree: DataFrame, member_counts: DataFrame) -> DataFrame:
    """(community_id, subtree_size): the members of all leaves below, or a community's own if those are more. tree (id, path) as
    `hierarchies` gives, member_counts (community_id, member_count)."""
    below = tree.where("path is not null").select("id", F.explode("path").alias("ancestor"))
    inner = tree.where("parent_id is not null").select(F.col("parent_id").alias("p")).distinct()
    leaves = below.join(inner, F.col("id") == F.col("p"), "left_anti")
    n = member_counts.select(F.col("community_id").alias("c"), F.coalesce("member_count", F.lit(0)).cast("bigint").alias("n"))
    up = leaves.join(n, F.col("id") == F.col("c")).groupBy(F.col("ancestor").alias("a")).agg(F.sum("n").alias("s"))
    return n.join(up, F.col("c") == F.col("a"), "left").select(F.col("c").alias("community_id"), F.greatest(F.coalesce("s", F.lit(0)), "n").cast("bigint").alias("subtree_size"))


def member_prompt(title: str, names: Column, most: int = 100) -> Column:
    more = F.size(names) - most
    tail = F.when(more > 0, F.concat(F.lit("\n(+"), more.cast("string"), F.lit(" more)"))).otherwise(F.lit(""))
    return F.concat(F.lit(title + "\n"), F.array_join(F.slice(names, 1, most), "\n"), tail)


def summarise(levels: DataFrame, model: Model, most_children: int = 12, most_levels: int = 3, least: int = 20) -> DataFrame:
    """(repo, level, cluster, title, summary), level by level: leaves from their members, the others from their children's
    summaries, placeholders left out. levels (repo, level, fqn, cluster). A summary shorter than `least` is a placeholder.

    Lists are cut to what a prompt holds before they are gathered.
    """
    guard = lambda s: F.when(F.length(F.coalesce(s, F.lit(""))) < least, PLACEHOLDER).otherwise(s)
    first = F.substring(F.substring_index("summary", "\n", 1), 1, 80)
    from pyspark.sql.window import Window

    place = F.row_number().over(Window.partitionBy("repo", "level", "cluster").orderBy("fqn"))
    zero = levels.where("level = 0").withColumn("_p", place)
    n = zero.groupBy("repo", "level", "cluster").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.when(F.col("_p") <= 100, F.col("fqn")))).alias("names"))
    more = F.when(F.col("n") > 100, F.concat(F.lit("\n(+"), (F.col("n") - 100).cast("string"), F.lit(" more)"))).otherwise(F.lit(""))
    done = n.select("repo", "level", "cluster", guard(model(F.concat(F.lit("Members:\n"), F.array_join("names", "\n"), more))).alias("summary"))
    out = done
    for level in range(1, most_levels):
        up = levels.where(F.col("level") == level).select("repo", "fqn", F.col("cluster").alias("up"))
        down = levels.where(F.col("level") == level - 1).select("repo", "fqn", F.col("cluster").alias("cluster"))
        kids = up.join(down, ["repo", "fqn"]).select("repo", "up", "cluster").distinct().join(done.drop("level"), ["repo", "cluster"]).where(F.col("summary") != PLACEHOLDER)
        rank = F.row_number().over(Window.partitionBy("repo", "up").orderBy("cluster"))
        kids = kids.withColumn("_r", rank).where(F.col("_r") <= most_children)
        per = kids.groupBy("repo", "up").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("cluster", "summary"))), lambda k: k.summary), "\n\n").alias("text"))
        every = up.select("repo", "up").distinct().join(per, ["repo", "up"], "left")
        text = F.when(F.col("text").isNotNull(), guard(model(F.concat(F.lit("Parts:\n"), "text")))).otherwise(PLACEHOLDER)
        done = every.select("repo", F.lit(level).alias("level"), F.col("up").alias("cluster"), text.alias("summary"))
        out = out.unionByName(done)
    return out.select("repo", "level", "cluster", first.alias("title"), "summary")


def storable_vectors(vectors: DataFrame, communities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, refused): vectors of summarised communities whose summary is a real one, and the others."""
    real = communities.where(F.col("summarized_at").isNotNull() & (F.coalesce("summary", F.lit("")) != "") & (F.col("summary") != PLACEHOLDER)).select("community_id").distinct()
    return vectors.join(real, "community_id", "left_semi"), vectors.join(real, "community_id", "left_anti")


def community_stage(nodes: DataFrame, edges: DataFrame, chunks: DataFrame, file_sha: DataFrame, model: Model, before: DataFrame | None = None, embed=None) -> dict[str, DataFrame]:
    """The community tables of an index: `communities` (repo, level, community_id, parent_id, member_count, content_sha, title,
    summary, from_cache), `members` (community_id, fqn, is_seed) of all levels, seeds on the first, and with `embed`, a function of
    the summary's column, `vectors` (community_id, vector) of those with a real summary. before (content_sha, detected_at, title,
    summary) are the communities of the last run: where the content is the same, their summaries are taken over."""
    own = nodes.where("fqn is not null").groupBy("fqn").agg(F.max("repo").alias("repo"))
    g = symmetrise(edges, nodes).join(own.withColumnRenamed("fqn", "a"), "a").select("repo", "a", "b", "weight")
    levels = written(leiden.communities(g), "levels")
    found = written(with_ids(leiden.parents(levels)), "communities")
    at = found.select(F.col("repo").alias("c_repo"), F.col("level").alias("c_level"), F.col("cluster").alias("c_cluster"), "community_id")
    members = levels.join(at, levels.repo.eqNullSafe(at.c_repo) & (levels.level == at.c_level) & (levels.cluster == at.c_cluster)).select("community_id", "level", "fqn")
    members = written(members, "members")
    seeds = seed_members(members.where("level = 0").select("community_id", "fqn"), edges, chunks, by_leaf=True)
    marked = mark_seeds(members.select("community_id", "fqn"), seeds)
    sha = content_sha(members.select("community_id", "fqn"), nodes, file_sha)
    told = summarise(levels, model).select(F.col("repo").alias("t_repo"), F.col("level").alias("t_level"), F.col("cluster").alias("t_cluster"), "title", "summary")
    rows = found.join(sha, "community_id", "left")
    rows = rows.join(told, rows.repo.eqNullSafe(told.t_repo) & (rows.level == told.t_level) & (rows.cluster == told.t_cluster), "left")
    if before is not None:
        kept = summary_cache(rows.select("community_id", "content_sha"), before, PLACEHOLDER).select(F.col("community_id").alias("k_id"), F.col("title").alias("k_title"), F.col("summary").alias("k_summary"), "from_cache")
        rows = rows.join(kept, rows.community_id == kept.k_id, "left").withColumn("title", F.coalesce("k_title", "title")).withColumn("summary", F.coalesce("k_summary", "summary"))
    else:
        rows = rows.withColumn("from_cache", F.lit(False))
    table = written(rows.select("repo", "level", "community_id", "parent_id", "member_count", "content_sha", "title", F.coalesce("summary", F.lit(PLACEHOLDER)).alias("summary"), "from_cache"), "community_table")
    out = {"communities": table, "members": marked}
    if embed is not None:
        out["vectors"] = table.where(F.col("summary") != PLACEHOLDER).select("community_id", embed(F.col("summary")).alias("vector"))
    return out
