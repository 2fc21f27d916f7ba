"""Queries of the stored tables, indexes and routes: writes into tables that hold rows already, look-ups, incremental runs, a stored
vector index, the community route, and invariants of results that SQL cannot give itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions import scalars as S
from millrace.operators import answer, communities, evaluate, graph, leiden, retrieve, tables, text, vector
from millrace.operators.changes import latest_by
from millrace.operators.index import CodeIndex
from millrace.queries.reference import _chunk_texts, _queries, _questions, _vectors
from millrace.queries.tables import read
from millrace.session import fresh_path, written

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def _halves(df: DataFrame, at: str) -> tuple[DataFrame, DataFrame]:
    """A table as it was up to the mean time, and what came after."""
    mean = df.agg(F.avg(at)).first()[0] or 0
    return df.where(F.col(at) < mean), df.where(F.col(at) >= mean)


# ---- writes into tables that hold rows ----


@query("""WITH n AS (SELECT *, indexed_at >= (SELECT avg(indexed_at) FROM nodes) AS late FROM nodes WHERE fqn IS NOT NULL)
  SELECT fqn, r.kind AS kind, r.path AS path, r.start_line AS start_line FROM (SELECT fqn, max({'n': late, 'o': indexed_at, 'kind': kind, 'path': path, 'start_line': start_line}) AS r FROM n GROUP BY fqn)""")
def node_upsert_into(spark, d):
    old, new = _halves(read(spark, d, "nodes").where("fqn is not null").select("fqn", "kind", "path", "start_line", "indexed_at"), "indexed_at")
    return tables.upsert(old, new, ["fqn"], "indexed_at").select("fqn", "kind", "path", "start_line")


@query("""SELECT src, dst, kind, src_line, CAST(sum(coalesce(weight, 1)) AS BIGINT) AS weight, min({'t': indexed_at, 'p': src_path}).p AS src_path
  FROM edges GROUP BY src, dst, kind, src_line""")
def edge_upsert_into(spark, d):
    old, new = _halves(read(spark, d, "edges"), "indexed_at")
    merged = tables.upsert_edges(old, new.limit(0)).withColumn("indexed_at", F.lit(0).cast("bigint"))
    return tables.upsert_edges(merged, new)


@query("""SELECT chunk_id, r.repo AS repo, r.path AS path, r.start_line AS start_line, r.file_sha AS file_sha FROM (SELECT chunk_id, max({'t': created_at, 'repo': repo, 'path': path,
  'start_line': start_line, 'file_sha': file_sha}) AS r FROM chunks WHERE chunk_id IS NOT NULL GROUP BY chunk_id)""")
def chunk_upsert_into(spark, d):
    old, new = _halves(read(spark, d, "chunks").where("chunk_id is not null").select("chunk_id", "repo", "path", "start_line", "file_sha", "created_at"), "created_at")
    return tables.upsert(old, new, ["chunk_id"], "created_at").drop("created_at")


@query("""WITH v AS (SELECT chunk_id, model, dim, created_at, model <> 'codevec-64' AS late FROM chunk_embeddings WHERE chunk_id IS NOT NULL AND model IS NOT NULL)
  SELECT chunk_id, r.model AS model, r.dim AS dim FROM (SELECT chunk_id, max({'n': late, 't': created_at, 'model': model, 'dim': dim}) AS r FROM v GROUP BY chunk_id)""")
def embedding_upsert_into(spark, d):
    """A vector of another model replaces that of the first, as the key is the chunk alone."""
    v = read(spark, d, "chunk_embeddings").where("chunk_id is not null and model is not null").select("chunk_id", "model", "dim", "created_at")
    return tables.upsert(v.where("model = 'codevec-64'"), v.where("model <> 'codevec-64'"), ["chunk_id"], "created_at").select("chunk_id", "model", "dim")


@query("""SELECT repo, path, r.s AS file_sha, r.p AS parse_status FROM (SELECT repo, path, max({'t': last_indexed_at, 's': coalesce(file_sha, ''), 'p': coalesce(parse_status, '')}) AS r FROM file_meta GROUP BY repo, path)""")
def file_meta_upsert_into(spark, d):
    m = read(spark, d, "file_meta").select("repo", "path", F.coalesce("file_sha", F.lit("")).alias("file_sha"), F.coalesce("parse_status", F.lit("")).alias("parse_status"), "last_indexed_at")
    old, new = _halves(m, "last_indexed_at")
    return tables.upsert(old, new, ["repo", "path"], "last_indexed_at").drop("last_indexed_at")


@query("""WITH c AS (SELECT *, detected_at >= (SELECT avg(detected_at) FROM communities) AS late FROM communities)
  SELECT DISTINCT community_id, repo, level, coalesce(parent_id, 0) AS parent_id FROM c WHERE late OR repo NOT IN (SELECT repo FROM c WHERE late AND repo IS NOT NULL)""")
def community_replace(spark, d):
    """A new detection replaces all communities of its repositories."""
    old, new = _halves(read(spark, d, "communities"), "detected_at")
    kept = tables.delete_where(old, new.where("repo is not null"), ["repo"])
    return kept.unionByName(new.select(*kept.columns)).select("community_id", "repo", "level", F.coalesce("parent_id", F.lit(0)).alias("parent_id")).distinct()


_GONE = "gone AS (SELECT DISTINCT repo, path FROM file_meta m WHERE NOT EXISTS (SELECT 1 FROM source_files s WHERE s.repo = m.repo AND s.path = m.path))"


@query(f"""WITH {_GONE} SELECT 'nodes' AS table_name, count(*) AS n_left FROM nodes n WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.repo = n.repo AND g.path = n.path)
  UNION ALL SELECT 'edges', count(*) FROM edges e WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.path = e.src_path)
  UNION ALL SELECT 'file_meta', count(*) FROM file_meta n WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.repo = n.repo AND g.path = n.path)
  UNION ALL SELECT 'chunks', count(*) FROM chunks n WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.repo = n.repo AND g.path = n.path)
  UNION ALL SELECT 'chunk_embeddings', count(*) FROM chunk_embeddings v WHERE EXISTS (SELECT 1 FROM chunks n WHERE n.chunk_id = v.chunk_id AND NOT EXISTS (SELECT 1 FROM gone g WHERE g.repo = n.repo AND g.path = n.path))""")
def delete_files(spark, d):
    """What stays of each table when the files that left the tree go, with all that hangs on them."""
    gone = tables.delete_where(read(spark, d, "file_meta").select("repo", "path").distinct(), read(spark, d, "source_files"), ["repo", "path"])
    by_path = gone.select(F.col("path").alias("src_path"))
    chunks = tables.delete_where(read(spark, d, "chunks"), gone, ["repo", "path"])
    left = {
        "nodes": tables.delete_where(read(spark, d, "nodes"), gone, ["repo", "path"]),
        "edges": tables.delete_where(read(spark, d, "edges"), by_path, ["src_path"]),
        "file_meta": tables.delete_where(read(spark, d, "file_meta"), gone, ["repo", "path"]),
        "chunks": chunks,
        "chunk_embeddings": tables.cascade(read(spark, d, "chunk_embeddings"), chunks, "chunk_id"),
    }
    out = None
    for name, t in left.items():
        n = t.agg(F.count("*").alias("n_left")).select(F.lit(name).alias("table_name"), "n_left")
        out = n if out is None else out.unionByName(n)
    return out


@query("""WITH hot AS (SELECT repo FROM nodes WHERE repo IS NOT NULL GROUP BY repo ORDER BY count(*) DESC, repo LIMIT 1)
  SELECT 'nodes' AS table_name, count(*) AS n_left FROM nodes WHERE repo IS NULL OR repo NOT IN (SELECT repo FROM hot)
  UNION ALL SELECT 'edges', count(*) FROM edges WHERE src_path IS NULL OR src_path NOT IN (SELECT path FROM file_meta WHERE repo IN (SELECT repo FROM hot) AND path IS NOT NULL)
  UNION ALL SELECT 'file_meta', count(*) FROM file_meta WHERE repo IS NULL OR repo NOT IN (SELECT repo FROM hot)
  UNION ALL SELECT 'communities', count(*) FROM communities WHERE repo IS NULL OR repo NOT IN (SELECT repo FROM hot)""")
def clear_repo(spark, d):
    """What stays of each table without the repository of most symbols."""
    n = read(spark, d, "nodes")
    hot = n.where("repo is not null").groupBy("repo").count().orderBy(F.col("count").desc(), "repo").limit(1).select("repo")
    meta = read(spark, d, "file_meta")
    own = meta.join(F.broadcast(hot), "repo", "left_semi").select(F.col("path").alias("src_path"))
    left = {"nodes": tables.delete_where(n, hot, ["repo"]), "edges": tables.delete_where(read(spark, d, "edges"), own, ["src_path"]), "file_meta": tables.delete_where(meta, hot, ["repo"]), "communities": tables.delete_where(read(spark, d, "communities"), hot, ["repo"])}
    out = None
    for name, t in left.items():
        c = t.agg(F.count("*").alias("n_left")).select(F.lit(name).alias("table_name"), "n_left")
        out = c if out is None else out.unionByName(c)
    return out


@query("SELECT chunk_id, model, count(*) AS n FROM chunk_embeddings v WHERE model = 'codevec-64' AND NOT EXISTS (SELECT 1 FROM chunks c WHERE c.chunk_id = v.chunk_id AND c.language = 'go') GROUP BY chunk_id, model")
def embedding_deletes(spark, d):
    """The vectors that are left without those of other models and of the chunks of one language."""
    v = read(spark, d, "chunk_embeddings").where("model = 'codevec-64'")
    return tables.delete_where(v, read(spark, d, "chunks").where("language = 'go'"), ["chunk_id"]).groupBy("chunk_id", "model").agg(F.count("*").alias("n"))


# ---- look-ups ----


@query("""WITH asked AS (SELECT DISTINCT dst AS fqn FROM edges WHERE kind = 'inherit')
  SELECT a.fqn, r.kind AS kind, r.repo AS repo, r.path AS path, r.start_line AS start_line FROM asked a LEFT JOIN (SELECT fqn, max({'t': indexed_at, 'kind': kind, 'repo': repo, 'path': path, 'start_line': start_line}) AS r FROM nodes GROUP BY fqn) USING (fqn)""")
def get_nodes(spark, d):
    """The current row of every symbol that something inherits from; nulls for those that are not there."""
    asked = read(spark, d, "edges").where("kind = 'inherit' and dst is not null").select(F.col("dst").alias("fqn")).distinct()
    return asked.join(latest_by(read(spark, d, "nodes").where("fqn is not null"), ["fqn"], ["indexed_at"], ["kind", "repo", "path", "start_line"]), "fqn", "left")


@query("SELECT repo, community_id, level, title FROM (SELECT repo, community_id, level, title, row_number() OVER (PARTITION BY community_id ORDER BY detected_at DESC, level DESC, coalesce(title, '') DESC) AS rn FROM communities WHERE community_id IS NOT NULL) WHERE rn = 1")
def communities_of_repo(spark, d):
    """Every community in its current form, by repository."""
    w = Window.partitionBy("community_id").orderBy(F.col("detected_at").desc(), F.col("level").desc(), F.coalesce("title", F.lit("")).desc())
    return read(spark, d, "communities").where("community_id is not null").withColumn("rn", F.row_number().over(w)).where("rn = 1").select("repo", "community_id", "level", "title")


@query("""WITH m AS (SELECT DISTINCT repo AS community_id, fqn FROM nodes WHERE fqn IS NOT NULL), asked AS (SELECT DISTINCT dst AS fqn FROM edges WHERE kind = 'call')
  SELECT m.fqn, m.community_id FROM m JOIN asked USING (fqn)""")
def find_by_member(spark, d):
    """The communities of every symbol that is called; repositories stand for communities."""
    m = read(spark, d, "nodes").where("fqn is not null").select(F.col("repo").alias("community_id"), "fqn").distinct()
    asked = read(spark, d, "edges").where("kind = 'call'").select(F.col("dst").alias("fqn")).distinct()
    return m.join(asked, "fqn").select("fqn", "community_id")


def _community_vectors(spark: SparkSession, d: str) -> DataFrame:
    v = read(spark, d, "community_embeddings").where("community_id is not null and model = 'codevec-64' and size(vector) = 64")
    return v.groupBy("community_id").agg(F.max(F.struct("created_at", "vector")).alias("r")).select(F.col("community_id").alias("item"), F.col("r.vector").alias("vector"))


_TOP5 = """SELECT query_id, item, distance, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, item) AS rank FROM
  (SELECT q.id AS query_id, b.id AS item, round(1 - list_cosine_similarity(q.v, b.v), 6) + 0.0 AS distance FROM v q JOIN v b ON q.id <> b.id WHERE q.id % 50 = 0)) WHERE rank <= 5"""


@query(f"""WITH v AS (SELECT community_id AS id, CAST(max({{'t': created_at, 'v': vector}}).v AS DOUBLE[]) AS v FROM community_embeddings WHERE community_id IS NOT NULL AND model = 'codevec-64' AND len(vector) = 64 GROUP BY 1) {_TOP5}""")
def community_topk(spark, d):
    """The five communities most similar to each of the stated ones, every fiftieth by id."""
    v = _community_vectors(spark, d)
    return vector.top_k(v.where("item % 50 = 0").withColumnRenamed("item", "query_id"), v, 5, "cosine", exclude_self=True)


@query("""WITH s AS (SELECT chunk_id, max({'path': path, 'lo': start_line}).path AS path FROM chunks GROUP BY chunk_id), c AS (SELECT chunk_id, lower(path) AS cited FROM s)
  SELECT s.chunk_id AS query_id, CAST(len(list_distinct([path, cited])) AS INTEGER) AS n_paths, list_contains([path, cited], path) AS holds FROM s JOIN c USING (chunk_id)""")
def hit_paths(spark, d):
    """The paths of retrieved chunks together with those that an answer cites, here in lower case."""
    s = read(spark, d, "chunks").groupBy("chunk_id").agg(F.max(F.struct("path", "start_line")).alias("r")).select("chunk_id", F.array("r.path").alias("found"), F.array(F.lower("r.path")).alias("cited"), "r.path")
    paths = evaluate.hit_paths(F.col("found"), F.col("cited"))
    return s.select(F.col("chunk_id").alias("query_id"), F.size(paths).alias("n_paths"), F.array_contains(paths, F.col("path")).alias("holds"))


@query("""SELECT community_id, coalesce(max(title), '') || '|' || coalesce(max(summary), '') AS parsed FROM communities WHERE summary IS NOT NULL AND title IS NOT NULL GROUP BY community_id HAVING count(DISTINCT coalesce(title, '') || summary) = 1""")
def summary_parse(spark, d):
    """Summaries put into the JSON of a model's answer and read back."""
    c = read(spark, d, "communities").where("summary is not null and title is not null").select("community_id", "title", "summary").distinct()
    c = c.withColumn("n", F.count("*").over(Window.partitionBy("community_id"))).where("n = 1")
    said = F.concat(F.lit("Here it is:\n"), F.to_json(F.struct("title", "summary")), F.lit("\nDone."))
    got = c.select("community_id", S.parse_summary(said).alias("p"))
    return got.select("community_id", F.concat_ws("|", "p.title", "p.summary").alias("parsed"))


# ---- incremental runs ----


def _listings(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The tree as first listed, without files that the index never saw but with those that left since; and as listed last."""
    s = read(spark, d, "source_files").where("path is not null")
    last = latest_by(s, ["repo", "path"], ["seen_at"], ["file_sha", "text"]).select("repo", "path", "text", "file_sha")
    first = s.groupBy("repo", "path").agg(F.min(F.struct("seen_at", "file_sha", "text")).alias("r")).select("repo", "path", F.col("r.text").alias("text"), F.col("r.file_sha").alias("file_sha"))
    meta = read(spark, d, "file_meta").select(F.col("repo").alias("m_repo"), F.col("path").alias("m_path")).distinct()
    known = first.join(meta, first.repo.eqNullSafe(F.col("m_repo")) & (first.path == F.col("m_path")), "left_semi")
    gone = meta.join(s.select("repo", "path").distinct(), s.repo.eqNullSafe(F.col("m_repo")) & (s.path == F.col("m_path")), "left_anti").where("m_path is not null")
    return known.unionByName(gone.select(F.col("m_repo").alias("repo"), F.col("m_path").alias("path"), F.lit("").alias("text"), F.lit("gone").alias("file_sha"))), last


_RUNS = """f AS (SELECT repo, path, lower(min({'t': seen_at, 's': file_sha}).s) AS first_sha, lower(max({'t': seen_at, 's': file_sha}).s) AS sha FROM source_files WHERE path IS NOT NULL GROUP BY repo, path),
  m AS (SELECT DISTINCT repo, path FROM file_meta WHERE path IS NOT NULL),
  changes AS (SELECT f.repo, f.path, CASE WHEN m.path IS NULL THEN 'added' WHEN first_sha IS NOT DISTINCT FROM sha THEN 'unchanged' ELSE 'modified' END AS change FROM f LEFT JOIN m ON m.repo IS NOT DISTINCT FROM f.repo AND m.path = f.path
    UNION ALL SELECT m.repo, m.path, 'deleted' FROM m LEFT JOIN f ON m.repo IS NOT DISTINCT FROM f.repo AND m.path = f.path WHERE f.path IS NULL)"""


@query(f"WITH {_RUNS} SELECT repo, change, count(*) AS n_files FROM changes GROUP BY repo, change")
def index_incremental(spark, d):
    """The manifest of a second run over the tree as listed last, after a first over the tree as listed first."""
    before, now = _listings(spark, d)
    index = CodeIndex(spark, fresh_path(spark, "index"))
    index.run(before)
    return index.run(now).groupBy("repo", "change").agg(F.sum("n_files").alias("n_files"))


@query("SELECT * FROM (VALUES ('chunks', 0), ('edges', 0), ('nodes', 0)) t(table_name, n_different)")
def index_equals_rebuild(spark, d):
    """Rows in which the tables after two runs differ from those of one run over the last listing."""
    before, now = _listings(spark, d)
    index, whole = (CodeIndex(spark, fresh_path(spark, "index")) for _ in range(2))
    index.run(before)
    index.run(now)
    whole.run(now)
    out = None
    for name in ("nodes", "edges", "chunks"):
        a, b = (getattr(x, name)() for x in (index, whole))
        digest = lambda t: t.select(F.sha2(F.to_json(F.struct(*sorted(t.columns))), 256).alias("h"))
        both = digest(a).withColumn("side", F.lit(1)).unionByName(digest(b).withColumn("side", F.lit(-1)))
        n = both.groupBy("h").agg(F.sum("side").alias("s")).agg(F.coalesce(F.sum(F.abs("s")), F.lit(0)).cast("int").alias("n_different"))
        n = n.select(F.lit(name).alias("table_name"), "n_different")
        out = n if out is None else out.unionByName(n)
    return out


# ---- stored vectors ----


@query("SELECT CAST(count(*) AS BIGINT) AS n_items, CAST(count(*) AS BIGINT) AS n_recovered, true AS same_answers FROM embeddings")
def vector_index_lifecycle(spark, d):
    """An index built in two batches, the second of which replaces vectors of the first, and what a recovered snapshot holds."""
    v = _vectors(spark, d)
    index = vector.VectorIndex.create(spark, fresh_path(spark, "vectors"), 64, "cosine", "drv", shard_rows=500)
    index.add(v.withColumn("vector", F.transform("vector", lambda x: -x)).where("item < 200"))
    index.add(v)
    index.snapshot(path := fresh_path(spark, "snapshot"))
    back = vector.VectorIndex(spark, path)
    q = _queries(spark, d)
    truth = vector.top_k(q, v, 10)
    ok = None
    for x in (index, back):
        r = evaluate.recall_at_k(truth, x.search(q, 10, 128), 10).agg(F.avg("recall").alias("r"))
        ok = r if ok is None else ok.unionByName(r)
    counts = spark.createDataFrame([(index.count(), back.count())], "n_items bigint, n_recovered bigint")
    return counts.crossJoin(ok.agg((F.min("r") >= 0.96).alias("same_answers")))  # one row each


@query("SELECT chunk_id, 32 AS n, CAST(1 AS DOUBLE) AS norm, true AS same FROM (SELECT DISTINCT chunk_id FROM chunks)")
def hash_embed_norms(spark, d):
    """Hashed embeddings are of unit length and the same for equal texts."""
    t = _chunk_texts(spark, d)
    v = t.select("chunk_id", vector.hash_embed(F.col("text"), 32).alias("a"), vector.hash_embed(F.concat("text", F.lit("")), 32).alias("b"))
    return v.select("chunk_id", F.size("a").alias("n"), F.round(vector.dot(F.col("a"), F.col("a")), 5).alias("norm"), (F.col("a") == F.col("b")).alias("same"))


# ---- communities and answers ----


def _graph(spark: SparkSession, d: str) -> DataFrame:
    n = read(spark, d, "nodes").groupBy("fqn").agg(F.max("repo").alias("repo"))
    return graph.symmetrise(read(spark, d, "edges"), read(spark, d, "nodes")).join(n.withColumnRenamed("fqn", "a"), "a").select("repo", "a", "b", "weight")


@query("""WITH n AS (SELECT fqn, max(repo) AS repo FROM nodes WHERE fqn IS NOT NULL GROUP BY fqn), g AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b
  FROM edges WHERE kind IN ('call', 'inherit') AND src <> dst AND src IN (SELECT fqn FROM n) AND dst IN (SELECT fqn FROM n)), v AS (SELECT repo, a AS x FROM g JOIN n ON n.fqn = a UNION SELECT repo, b FROM g JOIN n ON n.fqn = a)
  SELECT repo, count(*) AS n_vertices, count(*) AS n_placed, CAST(0 AS BIGINT) AS n_split FROM v GROUP BY repo""")
def leiden_invariants(spark, d):
    """Per repository: its vertices, those with exactly one cluster on the first level, and clusters whose members the next level parts."""
    levels = written(leiden.communities(_graph(spark, d)), "levels")
    g = _graph(spark, d)
    v = g.select("repo", F.explode(F.array("a", "b")).alias("fqn")).distinct()
    zero = levels.where("level = 0").groupBy("repo", "fqn").agg(F.count("*").alias("n"))
    placed = v.join(zero, ["repo", "fqn"], "left").groupBy("repo").agg(F.count("*").alias("n_vertices"), F.sum((F.coalesce("n", F.lit(0)) == 1).cast("bigint")).alias("n_placed"))
    up = levels.select("repo", (F.col("level") - 1).alias("level"), "fqn", F.col("cluster").alias("up"))
    parted = levels.join(up, ["repo", "level", "fqn"]).groupBy("repo", "level", "cluster").agg(F.countDistinct("up").alias("k")).groupBy("repo").agg(F.sum((F.col("k") > 1).cast("bigint")).alias("n_split"))
    return placed.join(parted, "repo", "left").withColumn("n_split", F.coalesce("n_split", F.lit(0)))


@query("""WITH n AS (SELECT fqn, max(repo) AS repo FROM nodes WHERE fqn IS NOT NULL GROUP BY fqn), g AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b
  FROM edges WHERE kind IN ('call', 'inherit') AND src <> dst AND src IN (SELECT fqn FROM n) AND dst IN (SELECT fqn FROM n)), v AS (SELECT repo, a AS x FROM g JOIN n ON n.fqn = a UNION SELECT repo, b FROM g JOIN n ON n.fqn = a)
  SELECT repo, count(*) AS n_leaf_members, CAST(0 AS BIGINT) AS n_lost_parents, CAST(0 AS BIGINT) AS n_without_summary, true AS all_kept FROM v GROUP BY repo""")
def community_index(spark, d):
    """The community stage twice, the second with the summaries of the first: members of leaves, parents that are not there, and
    whether every real summary was taken over, per repository."""
    n, e, c = (read(spark, d, t) for t in ("nodes", "edges", "chunks"))
    sha = read(spark, d, "source_files").groupBy("repo", "path").agg(F.max("file_sha").alias("file_sha"))
    model = lambda p: F.concat(F.lit("It holds "), F.substring(F.regexp_replace(p, "\\s+", " "), 1, 60))
    first = communities.community_stage(n, e, c, sha, model)
    before = first["communities"].select("content_sha", F.lit(1).alias("detected_at"), "title", "summary")
    out = communities.community_stage(n, e, c, sha, lambda p: F.lit("Another text of enough length."), before, lambda s: vector.hash_embed(s, 16))
    t = out["communities"]
    ids = t.select(F.col("community_id").alias("p_id"))
    up = t.join(ids, t.parent_id == ids.p_id, "left")
    of = t.select("repo", "level", "community_id")
    leaf = out["members"].join(of.where("level = 0"), "community_id").groupBy("repo").agg(F.count("*").alias("n_leaf_members"))
    sums = up.groupBy("repo").agg(F.sum((F.col("parent_id").isNotNull() & F.col("p_id").isNull()).cast("bigint")).alias("n_lost_parents"), F.sum(F.col("summary").isNull().cast("bigint")).alias("n_without_summary"), F.min(F.col("from_cache") & F.col("summary").startswith("It holds")).alias("all_kept"))
    return leaf.join(sums, leaf.repo.eqNullSafe(sums.repo)).select(leaf.repo, "n_leaf_members", "n_lost_parents", "n_without_summary", "all_kept")


def _community_answers(spark: SparkSession, d: str) -> DataFrame:
    q = _questions(spark, d).withColumn("route_hint", F.lit("community"))
    v = _community_vectors(spark, d)
    hits = vector.top_k(q.select("query_id", vector.hash_embed(F.col("question")).alias("vector")), v, 5)
    current = latest_by(read(spark, d, "communities").where("community_id is not null"), ["community_id"], ["detected_at"], ["repo"])
    # a community's members are the symbols of its repository
    at = hits.join(current, F.col("item") == F.col("community_id")).groupBy("query_id", F.col("repo").alias("community_id")).agg(F.min("rank").alias("hit_rank")).where("community_id is not null")
    members = read(spark, d, "nodes").where("fqn is not null").select(F.col("repo").alias("community_id"), "fqn", (F.col("kind") == "class").alias("is_seed")).distinct()
    chunks = read(spark, d, "chunks").groupBy("chunk_id").agg(F.max(F.struct("created_at", "path", "start_line", "end_line", "symbol", "text")).alias("r")).select("chunk_id", "r.*")
    picked = retrieve.community_chunks(at, members, chunks).join(chunks, "chunk_id").select("query_id", F.col("place").alias("rank"), "path", "start_line", "end_line", "symbol", "text")
    fallback = text.bm25(q, _chunk_texts(spark, d), "chunk_id", "text", 8).join(chunks, F.col("doc") == F.col("chunk_id"))
    return answer.dispatch(q, read(spark, d, "nodes"), read(spark, d, "edges"), fallback, written(picked, "picked"))


@query("SELECT item_id AS query_id, 'community' AS route, true AS grounded FROM eval_items")
def community_answers(spark, d):
    """Every evaluation item through the community route: similar communities, chunks of their seeds, a prompt, the offline
    model, grounding."""
    a = _community_answers(spark, d)
    return a.select("query_id", F.coalesce("degraded_from", "route").alias("route"), (F.col("valid") & F.col("answer").isNotNull()).alias("grounded"))


@query("""WITH s AS (SELECT DISTINCT chunk_id, 'r' AS r FROM chunks) SELECT route, count(*) AS n FROM (SELECT CASE WHEN regexp_matches(text, '\\b([A-Za-z_]\\w*(?:\\.[A-Za-z_]\\w*)+)\\b') OR regexp_matches(text, '\\b([A-Za-z_]\\w*)\\s*\\(')
  OR regexp_matches(text, '\\b([a-z][a-z0-9]*(?:_[a-z0-9]+)+)\\b') THEN 'graph' ELSE 'hybrid' END AS route FROM eval_items) GROUP BY route""")
def route_counts(spark, d):
    return retrieve.route(_questions(spark, d)).groupBy("route").agg(F.count("*").alias("n"))


@query()
def sweep_vectors(spark, d):
    """Build and search settings against recall and speed, as the benchmark's rows with their Pareto front marked."""
    return evaluate.sweep(_queries(spark, d), _vectors(spark, d), ms=(8, 16), builds=(50,), searches=(16, 64), k=10)
