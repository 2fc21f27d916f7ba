"""Queries of the retrieval engine's own operators over the domain tables, each with its SQL.

Binding: symbols and edges are `nodes` and `edges`; questions are the rows of `eval_items`, or symbol names taken from `nodes`;
vectors are `embeddings`; texts are `chunks` and `documents`; latencies are `events`; communities are `communities`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions import scalars as S
from millrace.operators import answer, code, communities, evaluate, graph, grounding, leiden, retrieve, tables, text, vector
from millrace.operators.hierarchy import current_links, hierarchies
from millrace.queries.tables import read

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def _questions(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "eval_items").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))


def _asked(spark: SparkSession, d: str) -> DataFrame:
    """Every symbol that is called, by its last two segments."""
    n = read(spark, d, "nodes").where("kind = 'method'").select("fqn").distinct()
    return n.select(F.col("fqn").alias("query_id"), F.substring_index("fqn", ".", -2).alias("symbol"))


_ASKED = "asked AS (SELECT DISTINCT fqn AS query_id, array_to_string(string_split(fqn, '.')[-2:], '.') AS symbol FROM nodes WHERE kind = 'method')"
_EDGE = "e AS (SELECT src, dst, kind, src_line, sum(coalesce(weight, 1)) AS weight FROM edges GROUP BY src, dst, kind, src_line)"
_LIVE = "members AS (SELECT DISTINCT repo AS community_id, fqn FROM nodes WHERE fqn IS NOT NULL)"

# ---- scans, look-ups and adjacency ----


@query("""SELECT * FROM (SELECT query_id, fqn, row_number() OVER (PARTITION BY query_id ORDER BY fqn) AS rn FROM
  (SELECT DISTINCT query_id, fqn FROM (SELECT query_id, symbol FROM asked) a JOIN (SELECT DISTINCT fqn FROM nodes) n
   ON n.fqn = a.symbol OR (n.fqn LIKE '%.%' AND ends_with(lower(n.fqn), '.' || lower(a.symbol))))) WHERE rn <= 32""".replace("SELECT * FROM (", f"WITH {_ASKED} SELECT query_id, fqn FROM (", 1))
def graph_suffix_lookup(spark, d):
    return graph.suffix_lookup(_asked(spark, d), read(spark, d, "nodes"))


@query("SELECT DISTINCT n.fqn AS query_id, e.src AS caller, e.src_path, e.src_line FROM (SELECT DISTINCT fqn FROM nodes) n LEFT JOIN edges e ON e.dst = n.fqn AND e.kind = 'call'")
def graph_callers(spark, d):
    names = read(spark, d, "nodes").select(F.col("fqn").alias("query_id"), "fqn").distinct()
    return graph.callers(names, read(spark, d, "edges")).select("query_id", "caller", "src_path", "src_line").distinct()


@query("SELECT DISTINCT n.fqn AS query_id, e.dst AS other, e.kind FROM (SELECT DISTINCT fqn FROM nodes) n JOIN edges e ON e.src = n.fqn AND e.kind = 'call'")
def graph_callees(spark, d):
    names = read(spark, d, "nodes").select(F.col("fqn").alias("query_id"), "fqn").distinct()
    return graph.neighbours(names, read(spark, d, "edges"), "call", "out").select("query_id", "other", "kind").distinct()


@query("SELECT kind, count(*) AS n, count(DISTINCT dst) AS n_dst FROM edges GROUP BY kind")
def edge_kinds(spark, d):
    return read(spark, d, "edges").groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("dst").alias("n_dst"))


@query("SELECT DISTINCT p.fqn AS src, n.fqn AS dst FROM nodes n JOIN nodes p ON p.fqn = regexp_replace(n.fqn, '\\.[^.]*$', '') WHERE n.fqn LIKE '%.%'")
def def_edges(spark, d):
    return graph.def_edges(read(spark, d, "nodes"))


@query("SELECT dst, count(*) AS in_degree FROM edges WHERE kind = 'call' GROUP BY dst")
def in_degree(spark, d):
    return graph.in_degree(read(spark, d, "edges"))


@query("""WITH m AS (SELECT DISTINCT fqn FROM nodes WHERE kind = 'module' AND path IN (SELECT path FROM source_files WHERE mtime % 7 = 0))
  SELECT DISTINCT src_path AS path FROM edges WHERE kind = 'import' AND dst IN (SELECT fqn FROM m) AND src_path IS NOT NULL
  AND src_path NOT IN (SELECT path FROM source_files WHERE mtime % 7 = 0 AND path IS NOT NULL)""")
def import_ripple(spark, d):
    """The files that changed are those with an mtime divisible by seven, as a changed set to follow."""
    touched = read(spark, d, "source_files").where("mtime % 7 = 0")
    return graph.import_ripple(touched, read(spark, d, "nodes"), read(spark, d, "edges"))


@query("SELECT DISTINCT e.src_path FROM edges e WHERE kind = 'import'")
def importing_paths(spark, d):
    return read(spark, d, "edges").where("kind = 'import'").select("src_path").distinct()


# ---- writes ----


@query("""SELECT fqn, r.kind AS kind, r.path AS path, r.start_line AS start_line FROM (SELECT fqn, max({'n': 1, 'o': indexed_at, 'kind': kind,
  'path': path, 'start_line': start_line}) AS r FROM nodes WHERE fqn IS NOT NULL GROUP BY fqn)""")
def node_upsert_latest(spark, d):
    n = read(spark, d, "nodes").where("fqn is not null").select("fqn", "kind", "path", "start_line", "indexed_at")
    return tables.upsert(n.limit(0), n, ["fqn"], "indexed_at").select("fqn", "kind", "path", "start_line")


@query("""SELECT src, dst, kind, src_line, CAST(sum(coalesce(weight, 1)) AS BIGINT) AS weight, min({'t': indexed_at, 'p': src_path}).p AS src_path
  FROM edges GROUP BY src, dst, kind, src_line""")
def edge_upsert_weight(spark, d):
    e = read(spark, d, "edges")
    return tables.upsert_edges(e.limit(0), e)


@query("""WITH old AS (SELECT repo, path, max({'t': last_indexed_at, 's': lower(file_sha)}).s AS sha FROM file_meta GROUP BY repo, path),
  new AS (SELECT repo, path, max({'t': seen_at, 's': lower(file_sha)}).s AS sha FROM source_files GROUP BY repo, path)
  SELECT coalesce(o.repo, n.repo) AS repo, coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'deleted'
  WHEN o.sha IS NOT DISTINCT FROM n.sha THEN 'unchanged' ELSE 'modified' END AS change FROM old o FULL JOIN new n ON o.repo = n.repo AND o.path = n.path""")
def changeset(spark, d):
    old = read(spark, d, "file_meta").groupBy("repo", "path").agg(F.max(F.struct("last_indexed_at", F.lower("file_sha").alias("s"))).alias("r")).select("repo", "path", F.col("r.s").alias("sha"))
    new = read(spark, d, "source_files").groupBy("repo", "path").agg(F.max(F.struct("seen_at", F.lower("file_sha").alias("s"))).alias("r")).select("repo", "path", F.col("r.s").alias("sha"))
    return tables.change_set(old, new, ["repo", "path"], "sha")


@query("SELECT DISTINCT repo, path FROM file_meta m WHERE NOT EXISTS (SELECT 1 FROM source_files s WHERE s.repo = m.repo AND s.path = m.path)")
def deleted_files(spark, d):
    return tables.delete_where(read(spark, d, "file_meta").select("repo", "path").distinct(), read(spark, d, "source_files"), ["repo", "path"])


@query("SELECT chunk_id, model, dim, created_at FROM chunk_embeddings v WHERE EXISTS (SELECT 1 FROM chunks c WHERE c.chunk_id = v.chunk_id)")
def embeddings_cascade(spark, d):
    v = read(spark, d, "chunk_embeddings").select("chunk_id", "model", "dim", "created_at")
    return tables.cascade(v, read(spark, d, "chunks"), "chunk_id")


@query("SELECT model, count(*) AS n, max(dim) AS max_dim, min(dim) AS min_dim, max(dim) <> min(dim) AS mixed FROM chunk_embeddings GROUP BY model")
def embedding_model_stats(spark, d):
    return tables.model_stats(read(spark, d, "chunk_embeddings"))


@query("SELECT parse_status, count(*) AS n FROM file_meta GROUP BY parse_status")
def parse_status_counts(spark, d):
    return read(spark, d, "file_meta").groupBy("parse_status").agg(F.count("*").alias("n"))


@query("SELECT level, count(*) AS n FROM communities WHERE level IS NOT NULL GROUP BY ROLLUP (level)")
def community_level_stats(spark, d):
    return tables.level_counts(read(spark, d, "communities"))


@query("""WITH real AS (SELECT content_sha, max({'t': detected_at, 'title': title, 'summary': summary}) AS r FROM communities
  WHERE coalesce(summary, '') <> '' AND summary <> '<auto-summary unavailable>' GROUP BY content_sha)
  SELECT DISTINCT c.community_id, c.content_sha, r.title AS title, r.summary AS summary, r.summary IS NOT NULL AS from_cache
  FROM communities c LEFT JOIN real USING (content_sha)""")
def summary_cache(spark, d):
    c = read(spark, d, "communities")
    return tables.summary_cache(c.select("community_id", "content_sha").distinct(), c)


@query("SELECT DISTINCT c.community_id, e.model, c.level, c.title FROM community_embeddings e JOIN communities c USING (community_id) WHERE c.summarized_at IS NOT NULL")
def community_vectors(spark, d):
    c = read(spark, d, "communities").where("summarized_at is not null").select("community_id", "level", "title")
    return read(spark, d, "community_embeddings").join(c, "community_id").select("community_id", "model", "level", "title").distinct()


@query("SELECT DISTINCT community_id FROM community_embeddings e WHERE NOT EXISTS (SELECT 1 FROM communities c WHERE c.community_id = e.community_id AND c.summarized_at IS NOT NULL)")
def community_vector_violations(spark, d):
    return tables.delete_where(read(spark, d, "community_embeddings").select("community_id").distinct(), read(spark, d, "communities").where("summarized_at is not null"), ["community_id"])


@query("SELECT community_id, level, repo FROM (SELECT *, row_number() OVER (PARTITION BY repo, content_sha ORDER BY community_id, detected_at, level) AS rn FROM communities) WHERE rn = 1")
def community_by_content(spark, d):
    w = Window.partitionBy("repo", "content_sha").orderBy("community_id", "detected_at", "level")
    return read(spark, d, "communities").withColumn("rn", F.row_number().over(w)).where("rn = 1").select("community_id", "level", "repo")


@query("SELECT DISTINCT community_id, repo, level FROM communities WHERE parent_id IS NULL")
def community_top_level(spark, d):
    return read(spark, d, "communities").where("parent_id is null").select("community_id", "repo", "level").distinct()


# ---- clustering graph ----

_SYM = """n AS (SELECT DISTINCT fqn FROM nodes), g AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, CAST(sum(coalesce(weight, 1)) AS BIGINT) AS weight, count(*) AS n_rows
  FROM edges WHERE kind IN ('call', 'inherit') AND src <> dst AND NOT (starts_with(src, '<unresolved:') AND suffix(src, '>')) AND NOT (starts_with(dst, '<unresolved:') AND suffix(dst, '>'))
  AND src IN (SELECT fqn FROM n) AND dst IN (SELECT fqn FROM n) GROUP BY 1, 2)"""


@query(f"WITH {_SYM} SELECT a, b, weight, n_rows FROM g")
def subgraph_symmetrise(spark, d):
    return graph.symmetrise(read(spark, d, "edges"), read(spark, d, "nodes"))


@query(f"""WITH {_SYM}, v AS (SELECT a AS x FROM g UNION SELECT b FROM g) SELECT (SELECT count(*) FROM v) AS n_vertices, (SELECT count(*) FROM g) AS n_edges,
  (SELECT count(*) FROM edges WHERE kind IN ('call', 'inherit') AND (src NOT IN (SELECT fqn FROM n) OR dst NOT IN (SELECT fqn FROM n))) AS n_dropped,
  (SELECT CAST(sum(n_rows) - count(*) AS BIGINT) FROM g) AS n_collapsed, (SELECT count(*) FROM n) - (SELECT count(*) FROM v) AS n_isolated""")
def subgraph_stats(spark, d):
    return graph.subgraph_stats(read(spark, d, "edges"), read(spark, d, "nodes"))


def _by_module(spark, d):
    """Each vertex with its package, the first two segments of its name, as a membership to contract by."""
    return read(spark, d, "nodes").select(F.col("fqn").alias("v"), F.substring_index("fqn", ".", 2).alias("cluster")).distinct()


_MEMBER = "m AS (SELECT DISTINCT fqn AS v, array_to_string(string_split(fqn, '.')[:2], '.') AS cluster FROM nodes)"


@query(f"""WITH {_SYM}, {_MEMBER} SELECT least(x.cluster, y.cluster) AS a, greatest(x.cluster, y.cluster) AS b, CAST(sum(weight) AS BIGINT) AS weight
  FROM g JOIN m x ON x.v = g.a JOIN m y ON y.v = g.b WHERE x.cluster <> y.cluster GROUP BY 1, 2""")
def contract_graph(spark, d):
    return graph.contract(graph.symmetrise(read(spark, d, "edges"), read(spark, d, "nodes")), _by_module(spark, d))


@query(f"""WITH {_SYM}, {_MEMBER}, arcs AS (SELECT a AS v, b AS u, weight FROM g UNION ALL SELECT b, a, weight FROM g)
  SELECT arcs.v AS v, cluster, CAST(sum(weight) AS BIGINT) AS weight FROM arcs JOIN m ON m.v = u GROUP BY arcs.v, cluster""")
def incident_weight(spark, d):
    return graph.incident_weight(graph.symmetrise(read(spark, d, "edges"), read(spark, d, "nodes")), _by_module(spark, d))


@query(f"""WITH {_LIVE}, deg AS (SELECT dst, count(*) AS n FROM edges WHERE kind = 'call' GROUP BY dst),
  len AS (SELECT symbol, max(end_line - start_line + 1) AS n FROM chunks WHERE symbol IS NOT NULL GROUP BY symbol)
  SELECT * EXCLUDE rn, CAST(rn AS INTEGER) AS rank FROM (SELECT community_id, fqn, coalesce(deg.n, 0) AS in_degree, coalesce(len.n, 0) AS chunk_lines,
    CAST(3 * coalesce(deg.n, 0) + coalesce(len.n, 0) / 10 AS DOUBLE) AS score, row_number() OVER (PARTITION BY community_id ORDER BY 3 * coalesce(deg.n, 0) + coalesce(len.n, 0) / 10 DESC, fqn) AS rn
    FROM members LEFT JOIN deg ON deg.dst = fqn LEFT JOIN len ON len.symbol = array_to_string(string_split(fqn, '.')[-1:], '.')) WHERE rn <= 12""")
def seed_members(spark, d):
    """Repositories stand for communities; chunk symbols are compared to the last segment of names."""
    m = read(spark, d, "nodes").where("fqn is not null").select(F.col("repo").alias("community_id"), "fqn").distinct()
    return graph.seed_members(m, read(spark, d, "edges"), read(spark, d, "chunks"), by_leaf=True)


@query("""WITH n AS (SELECT fqn, max({'repo': repo, 'path': path}) AS r FROM nodes WHERE fqn IS NOT NULL GROUP BY fqn), s AS (SELECT repo, path, max(file_sha) AS file_sha FROM source_files GROUP BY repo, path),
  x AS (SELECT DISTINCT m.repo AS community_id, m.fqn, n.r.path AS path, s.file_sha FROM (SELECT DISTINCT repo, fqn FROM nodes WHERE fqn IS NOT NULL) m JOIN n USING (fqn) LEFT JOIN s ON s.repo = n.r.repo AND s.path = n.r.path)
  SELECT community_id, sha256((SELECT string_agg(chr(0) || 'fqn:' || fqn, '' ORDER BY fqn) FROM (SELECT DISTINCT fqn FROM x y WHERE y.community_id = z.community_id))
   || (SELECT string_agg(chr(0) || 'path:' || p || chr(0) || 'sha:' || f, '' ORDER BY chr(0) || 'path:' || p || chr(0) || 'sha:' || f) FROM (SELECT DISTINCT coalesce(path, '') AS p, coalesce(file_sha, '') AS f FROM x y WHERE y.community_id = z.community_id))) AS content_sha
  FROM (SELECT DISTINCT community_id FROM x) z""")
def content_sha(spark, d):
    m = read(spark, d, "nodes").where("fqn is not null").select(F.col("repo").alias("community_id"), "fqn").distinct()
    s = read(spark, d, "source_files").groupBy("repo", "path").agg(F.max("file_sha").alias("file_sha"))
    return graph.content_sha(m, read(spark, d, "nodes"), s)


@query()
def leiden_communities(spark, d):
    n = read(spark, d, "nodes").groupBy("fqn").agg(F.max("repo").alias("repo"))
    g = graph.symmetrise(read(spark, d, "edges"), read(spark, d, "nodes"))
    return leiden.parents(leiden.communities(g.join(n.withColumnRenamed("fqn", "a"), "a").select("repo", "a", "b", "weight")))


def _repo_graph(spark, d):
    n = read(spark, d, "nodes").groupBy("fqn").agg(F.max("repo").alias("repo"))
    g = graph.symmetrise(read(spark, d, "edges"), read(spark, d, "nodes"))
    return g.join(n.withColumnRenamed("fqn", "a"), "a").select("repo", "a", "b", "weight")


@query("SELECT CAST(0 AS BIGINT) AS n_different")
def distributed_communities(spark, d):
    """The same communities by joins and in tasks: how many rows differ."""
    one, two = (leiden.communities(_repo_graph(spark, d), cap=cap).withColumn("side", F.lit(s)) for cap, s in ((500_000, 1), (0, -1)))
    both = one.unionByName(two).groupBy("repo", "level", "fqn", "cluster").agg(F.sum("side").alias("s"))
    return both.agg(F.coalesce(F.sum(F.abs("s")), F.lit(0)).cast("bigint").alias("n_different"))


@query("""WITH e AS (SELECT DISTINCT src, dst FROM edges WHERE kind IN ('call', 'inherit')), arcs AS (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e),
  hits AS (SELECT DISTINCT fqn AS query_id, fqn FROM nodes WHERE kind = 'class') SELECT query_id, fqn, 0 AS hop FROM hits
  UNION ALL SELECT DISTINCT query_id, dst, 1 FROM hits JOIN arcs ON src = fqn WHERE dst <> query_id""")
def graph_expand(spark, d):
    hits = read(spark, d, "nodes").where("kind = 'class'").select(F.col("fqn").alias("query_id"), "fqn").distinct()
    return retrieve.expand_hops(hits, read(spark, d, "edges"))


# ---- text ----

_TOK = "list_filter(list_transform(regexp_extract_all({}, '[A-Za-z0-9]+'), lambda x: lower(x)), lambda x: length(x) > 1 AND NOT regexp_full_match(x, '[0-9]+'))"


@query(f"SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest({_TOK.format('text')}) AS term FROM documents) GROUP BY term")
def tokenize_df(spark, d):
    t = read(spark, d, "documents").select("doc_id", F.explode(S.tokens(F.col("text"))).alias("term")).distinct()
    return t.groupBy("term").agg(F.count("*").alias("df"))


_DISTINCT_CHUNKS = "c AS (SELECT chunk_id, min(text) AS text FROM chunks GROUP BY chunk_id)"


def _chunk_texts(spark, d):
    return read(spark, d, "chunks").groupBy("chunk_id").agg(F.min("text").alias("text"))


_BM25 = f"""{_DISTINCT_CHUNKS}, tk AS (SELECT chunk_id AS doc, {_TOK.format("text")} AS ts FROM c), tk2 AS (SELECT doc, CASE WHEN len(ts) = 0 THEN ['__empty_chunk__'] ELSE ts END AS ts FROM tk),
  tf AS (SELECT doc, dl, term, count(*) AS tf FROM (SELECT doc, len(ts) AS dl, unnest(ts) AS term FROM tk2) GROUP BY doc, dl, term),
  st AS (SELECT term, ln((SELECT count(*) FROM c) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM tf GROUP BY term),
  idf AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM st) ELSE raw END AS idf FROM st),
  q AS (SELECT query_id, term, count(*) AS qf FROM (SELECT item_id AS query_id, unnest({_TOK.format("text")}) AS term FROM eval_items) GROUP BY query_id, term),
  sc AS (SELECT query_id, doc, round(sum(qf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / (SELECT avg(len(ts)) FROM tk2)))), 6) AS score FROM tf JOIN idf USING (term) JOIN q USING (term) GROUP BY query_id, doc),
  sparse AS (SELECT * FROM (SELECT query_id, doc, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc) AS INTEGER) AS rank FROM sc WHERE score > 0) WHERE rank <= 50)"""


@query(f"WITH {_BM25} SELECT query_id, doc, score, rank FROM sparse")
def bm25_topk(spark, d):
    return text.bm25(_questions(spark, d), _chunk_texts(spark, d), "chunk_id", "text")


@query("""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
  w AS (SELECT doc_id, ls, unnest(range(0, CASE WHEN len(ls) <= 8 THEN 1 ELSE 1 + CAST(ceil((len(ls) - 8) / 6.0) AS INTEGER) END)) AS k FROM l),
  t AS (SELECT doc_id, CAST(k * 6 + 1 AS INTEGER) AS start_line, CAST(k * 6 + len(ls[k * 6 + 1:k * 6 + 8]) AS INTEGER) AS end_line, array_to_string(ls[k * 6 + 1:k * 6 + 8], chr(10)) AS text FROM w)
  SELECT doc_id, start_line, end_line, sha1('docs|' || doc_id || '|' || start_line || '-' || end_line || '|' || text) AS chunk_id FROM t WHERE regexp_matches(text, '\\S')""")
def chunk_windows(spark, d):
    w = text.line_windows(read(spark, d, "documents"), "doc_id", "text", 8, 2)
    return w.select("doc_id", "start_line", "end_line", S.chunk_id(F.lit("docs"), F.col("doc_id").cast("string"), F.col("start_line"), F.col("end_line"), F.col("text")).alias("chunk_id"))


# ---- vectors ----


def _vectors(spark, d):
    return read(spark, d, "embeddings").select(F.col("vec_id").alias("item"), F.col("embedding").alias("vector"))


def _queries(spark, d):
    """The stated query set: every vector whose id is divisible by 50."""
    return read(spark, d, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


def _knn(expr: str, k: int = 10) -> str:
    return f"""SELECT query_id, item, distance, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, item) AS rank FROM
      (SELECT q.vec_id AS query_id, b.vec_id AS item, round({expr}, 6) + 0.0 AS distance FROM embeddings q JOIN embeddings b ON q.vec_id <> b.vec_id WHERE q.vec_id % 50 = 0)) WHERE rank <= {k}"""


@query(_knn("1 - list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"))
def dense_cosine_topk(spark, d):
    return vector.top_k(_queries(spark, d), _vectors(spark, d), 10, "cosine", exclude_self=True)


@query(_knn("list_sum(list_transform(list_zip(CAST(q.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"))
def dense_l2_topk(spark, d):
    return vector.top_k(_queries(spark, d), _vectors(spark, d), 10, "l2", exclude_self=True)


@query(_knn("1 - list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"))
def dense_ip_topk(spark, d):
    return vector.top_k(_queries(spark, d), _vectors(spark, d), 10, "ip", exclude_self=True)


@query("SELECT vec_id, round(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x)), 6) AS norm2, CAST(1 AS DOUBLE) AS unit2 FROM embeddings")
def normalise_vectors(spark, d):
    v = read(spark, d, "embeddings")
    u = F.col("u")
    return v.withColumn("u", vector.normalise(F.col("embedding"))).select("vec_id", F.round(vector.dot(F.col("embedding"), F.col("embedding")), 6).alias("norm2"), F.round(vector.dot(u, u), 6).alias("unit2"))


@query("SELECT vec_id, 4 * len(embedding) AS n_bytes, true AS same FROM embeddings")
def vector_codec(spark, d):
    v = read(spark, d, "embeddings").withColumn("b", vector.encode_f32("embedding"))
    return v.select("vec_id", F.length("b").cast("bigint").alias("n_bytes"), (vector.decode_f32("b") == F.col("embedding")).alias("same"))


@query()
def hnsw_topk(spark, d):
    return vector.hnsw_top_k(_queries(spark, d), _vectors(spark, d), 10)


@query()
def hnsw_recall(spark, d):
    truth = vector.top_k(_queries(spark, d), _vectors(spark, d), 10)
    got = vector.hnsw_top_k(_queries(spark, d), _vectors(spark, d), 10)
    return evaluate.recall_at_k(truth, got, 10).agg(F.count("*").alias("n_queries"), F.round(F.avg("recall"), 4).alias("recall"))


@query()
def hash_embed(spark, d):
    return _chunk_texts(spark, d).select("chunk_id", vector.hash_embed(F.col("text"), 32).alias("vector"))


# ---- retrieval ----


def _labelled(spark, d):
    """Documents of the vectors' label: a second ranking to fuse with, by id."""
    v = read(spark, d, "embeddings")
    q = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "label")
    w = Window.partitionBy("query_id").orderBy("item")
    r = q.join(v.select(F.col("vec_id").alias("item"), "label"), "label").where("item <> query_id")
    return r.withColumn("rank", F.row_number().over(w)).where("rank <= 10").select("query_id", "item", "rank")


_FUSED = f"""dense AS ({_knn("1 - list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))")}),
  other AS (SELECT query_id, item, rank FROM (SELECT q.vec_id AS query_id, b.vec_id AS item, row_number() OVER (PARTITION BY q.vec_id ORDER BY b.vec_id) AS rank
    FROM embeddings q JOIN embeddings b ON q.label = b.label AND q.vec_id <> b.vec_id WHERE q.vec_id % 50 = 0) WHERE rank <= 10),
  both_ AS (SELECT query_id, item, rank, 0 AS side FROM dense UNION ALL SELECT query_id, item, rank, 1 FROM other),
  fused AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, place) AS INTEGER) AS rank FROM (SELECT query_id, item, round(sum(1 / (60.0 + rank)), 9) AS score,
    coalesce(min(rank) FILTER (side = 0), min(rank) + 1000000) AS place FROM both_ GROUP BY query_id, item))"""


@query(f"WITH {_FUSED} SELECT query_id, item, score, rank FROM fused")
def rrf_fuse(spark, d):
    dense = vector.top_k(_queries(spark, d), _vectors(spark, d), 10, "cosine", exclude_self=True)
    return retrieve.fuse(dense, _labelled(spark, d))


@query()
def hybrid_topk(spark, d):
    """Hashed embeddings and BM25 over all chunks for every evaluation item, fused, cut, hydrated and reranked."""
    q = _questions(spark, d)
    texts = _chunk_texts(spark, d)
    base = texts.select(F.col("chunk_id").alias("item"), vector.hash_embed(F.col("text")).alias("vector"))
    dense = vector.top_k(q.select("query_id", vector.hash_embed(F.col("question")).alias("vector")), base, 50)
    sparse = text.bm25(q, texts, "chunk_id", "text").select("query_id", F.col("doc").alias("item"), "rank")
    c = read(spark, d, "chunks").groupBy("chunk_id").agg(F.max(F.struct("created_at", "repo", "path", "start_line", "end_line", "text")).alias("r")).select("chunk_id", "r.*")
    return retrieve.hybrid(q, dense, sparse, c)


@query(f"""WITH {_BM25}, t AS (SELECT query_id, doc, rank, i.text AS question, c.text AS text FROM sparse JOIN eval_items i ON i.item_id = query_id JOIN c ON c.chunk_id = doc WHERE rank <= 20),
  o AS (SELECT query_id, doc AS item, rank, len(list_intersect(list_distinct(list_filter(regexp_split_to_array(lower(question), '\\s+'), lambda x: x <> '')), list_distinct(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '')))) AS overlap FROM t)
  SELECT query_id, item, CAST(overlap AS INTEGER) AS overlap, CAST(new_rank AS INTEGER) AS new_rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY overlap DESC, rank) AS new_rank FROM o) WHERE new_rank <= 8""")
def mock_rerank(spark, d):
    q, texts = _questions(spark, d), _chunk_texts(spark, d)
    s = text.bm25(q, texts, "chunk_id", "text").where("rank <= 20").select("query_id", F.col("doc").alias("chunk_id"), "rank")
    cand = s.join(texts, "chunk_id").join(q, "query_id").withColumnRenamed("chunk_id", "item")
    return retrieve.rerank(cand, 8).select("query_id", "item", "overlap", "new_rank")


@query("""SELECT item_id AS query_id, symbol, CASE WHEN symbol IS NULL THEN 'hybrid' ELSE 'graph' END AS route, CASE WHEN symbol IS NULL THEN 0.5 ELSE 0.9 END AS confidence FROM
  (SELECT item_id, coalesce(nullif(regexp_extract(text, '\\b([A-Za-z_]\\w*(?:\\.[A-Za-z_]\\w*)+)\\b', 1), ''), nullif(regexp_extract(text, '\\b([A-Za-z_]\\w*)\\s*\\(', 1), ''),
   nullif(regexp_extract(text, '\\b([a-z][a-z0-9]*(?:_[a-z0-9]+)+)\\b', 1), '')) AS symbol FROM eval_items)""")
def router_symbol_detect(spark, d):
    return retrieve.route(_questions(spark, d)).select("query_id", "symbol", "route", "confidence")


_GRAPH = """asked AS (SELECT query_id, coalesce(nullif(regexp_extract(question, '\\b([A-Za-z_]\\w*(?:\\.[A-Za-z_]\\w*)+)\\b', 1), ''), nullif(regexp_extract(question, '\\b([A-Za-z_]\\w*)\\s*\\(', 1), ''),
    nullif(regexp_extract(question, '\\b([a-z][a-z0-9]*(?:_[a-z0-9]+)+)\\b', 1), '')) AS symbol FROM (SELECT DISTINCT fqn AS query_id, 'Who calls ' || array_to_string(string_split(fqn, '.')[-2:], '.') || '?' AS question FROM nodes WHERE kind IN ('method', 'function'))),
  n AS (SELECT DISTINCT fqn, unnest(range(1, len(string_split(fqn, '.')) + 1)) AS k FROM nodes WHERE fqn IS NOT NULL), t AS (SELECT fqn, k, lower(array_to_string(string_split(fqn, '.')[k:], '.')) AS tail FROM n),
  hit AS (SELECT query_id, fqn FROM (SELECT query_id, fqn, row_number() OVER (PARTITION BY query_id ORDER BY fqn) AS rn FROM (SELECT DISTINCT query_id, fqn FROM asked JOIN t ON tail = lower(symbol) WHERE k > 1 OR fqn = symbol)) WHERE rn <= 32),
  c AS (SELECT src, dst, src_line, min(src_path) AS src_path FROM edges WHERE kind = 'call' AND src IS NOT NULL GROUP BY src, dst, src_line),
  b AS (SELECT query_id, fqn, count(src) AS n, CASE WHEN count(src) = 0 THEN '- ' || fqn || ' has no recorded callers.' ELSE '- ' || fqn || ':' || chr(10) || string_agg('    - ' || src || ' at [' || coalesce(src_path, '') || ':' || src_line || '-' || src_line || ']',
    chr(10) ORDER BY src_path NULLS FIRST, src_line, src) END AS t FROM hit LEFT JOIN c ON dst = fqn GROUP BY query_id, fqn)"""


def _who_calls(spark, d):
    names = read(spark, d, "nodes").where("kind in ('method', 'function')").select("fqn").distinct()
    return names.select(F.col("fqn").alias("query_id"), F.concat(F.lit("Who calls "), F.substring_index("fqn", ".", -2), F.lit("?")).alias("question"))


@query(f"""WITH {_GRAPH} SELECT a.query_id, a.symbol, coalesce(string_agg(t, chr(10) ORDER BY fqn), 'No symbol matching ' || chr(39) || coalesce(a.symbol, '') || chr(39) || ' in the index.') AS answer,
  CAST(coalesce(sum(n), 0) AS BIGINT) AS n_citations FROM asked a LEFT JOIN b ON b.query_id = a.query_id GROUP BY a.query_id, a.symbol""")
def graph_route(spark, d):
    return retrieve.graph_route(_who_calls(spark, d), read(spark, d, "nodes"), read(spark, d, "edges"))


@query(f"""WITH {_GRAPH} SELECT a.query_id, count(DISTINCT hit.fqn) AS n_symbols, count(src) AS n_callers FROM asked a LEFT JOIN hit ON hit.query_id = a.query_id LEFT JOIN c ON dst = hit.fqn GROUP BY a.query_id""")
def graph_lines(spark, d):
    r = retrieve.graph_lines(_who_calls(spark, d), read(spark, d, "nodes"), read(spark, d, "edges"))
    return r.groupBy("query_id").agg(F.sum((F.col("fqn").isNotNull() & F.col("caller").isNull()).cast("bigint")).alias("n_symbols"), F.count("caller").alias("n_callers"))


@query()
def community_chunks(spark, d):
    """Repositories stand for communities; those with the same first letter are one question's hits, in order of name. Their seeds
    are their classes."""
    repos = read(spark, d, "nodes").select(F.col("repo").alias("community_id")).where("repo is not null").distinct()
    hits = repos.withColumn("query_id", F.substring("community_id", 1, 1))
    hits = hits.withColumn("hit_rank", F.row_number().over(Window.partitionBy("query_id").orderBy("community_id")))
    members = read(spark, d, "nodes").select(F.col("repo").alias("community_id"), "fqn", (F.col("kind") == "class").alias("is_seed")).distinct()
    return retrieve.community_chunks(hits, members, read(spark, d, "chunks"))


# ---- grounding and answers ----


def _answers(spark, d):
    """One answer per chunk, citing the chunk's own lines, and beyond its end where it has an odd number of lines."""
    c = _spans(spark, d)
    cite = F.concat(F.lit("See ["), "path", F.lit(":"), F.col("start_line").cast("string"), F.lit("-"), (F.col("end_line") + F.pmod(F.col("end_line") - F.col("start_line"), F.lit(2))).cast("string"), F.lit("] and ["), "path", F.lit(":0-3]."))
    return c.select(F.col("chunk_id").alias("query_id"), cite.alias("answer"))


def _spans(spark, d):
    c = read(spark, d, "chunks").groupBy("chunk_id").agg(F.max(F.struct("path", "start_line", "end_line")).alias("r"))
    return c.select("chunk_id", "r.*")


_SPANS = "s AS (SELECT chunk_id, unnest(max({'path': path, 'start_line': start_line, 'end_line': end_line})) FROM chunks GROUP BY chunk_id)"


@query(f"""WITH {_SPANS} SELECT chunk_id AS query_id, path, CAST(start_line AS BIGINT) AS lo, CAST(end_line + (end_line - start_line) % 2 AS BIGINT) AS hi FROM s WHERE start_line > 0 AND end_line >= start_line""")
def citations_extract(spark, d):
    return _answers(spark, d).select("query_id", F.explode(S.valid_citations(F.col("answer"))).alias("c")).select("query_id", "c.path", "c.lo", "c.hi")


@query(f"WITH {_SPANS} SELECT chunk_id AS query_id, (end_line - start_line) % 2 = 0 AS valid, CAST((end_line - start_line) % 2 AS INTEGER) AS n_dropped FROM s")
def grounding_verify(spark, d):
    got = _spans(spark, d).withColumnRenamed("chunk_id", "query_id")
    return grounding.verify(_answers(spark, d), got).select("query_id", "valid", F.size("dropped").alias("n_dropped"))


@query(f"""WITH {_SPANS} SELECT chunk_id AS query_id, CASE WHEN (end_line - start_line) % 2 = 0 THEN 'See [' || path || ':' || start_line || '-' || end_line || ']'
  ELSE 'See [citation removed]' END || ' and [' || path || ':0-3].' AS answer FROM s""")
def citations_strip(spark, d):
    v = grounding.verify(_answers(spark, d), _spans(spark, d).withColumnRenamed("chunk_id", "query_id"))
    return grounding.strip_citations(v.select("query_id", "answer", "dropped")).select("query_id", "answer")


@query("""SELECT doc_id, sha256(coalesce(repo, '') || chr(31) || 'v1' || chr(31) || regexp_replace(text, '^\\s+|\\s+$', '', 'g') || chr(31) || 'auto' || chr(31) || '8' || chr(31) || 'mock') AS key FROM documents WHERE text IS NOT NULL""")
def cache_key(spark, d):
    docs = read(spark, d, "documents").where("text is not null")
    return docs.select("doc_id", S.cache_key(F.col("repo"), F.lit("v1"), F.col("text"), F.lit(None).cast("string"), F.lit(8), F.lit("mock")).alias("key"))


@query("""SELECT event_id, coalesce(CAST(json_extract(props, '$.k') AS BIGINT), -1) AS k FROM events""")
def json_parse(spark, d):
    return read(spark, d, "events").select("event_id", F.coalesce(F.from_json("props", "k bigint")["k"], F.lit(-1)).alias("k"))


@query("SELECT path, language FROM (SELECT DISTINCT path, CASE lower(regexp_extract(path, '(\\.[^./]+)$', 1)) WHEN '.py' THEN 'python' WHEN '.pyi' THEN 'python' WHEN '.ts' THEN 'typescript' WHEN '.tsx' THEN 'typescript' WHEN '.js' THEN 'javascript' WHEN '.jsx' THEN 'javascript' WHEN '.go' THEN 'go' END AS language FROM source_files)")
def language_detect(spark, d):
    return read(spark, d, "source_files").select("path", S.language_of(F.col("path")).alias("language")).distinct()


@query("SELECT DISTINCT path, regexp_replace(replace(regexp_replace(path, '\\.[^./]+$', ''), '/', '.'), '(^|\\.)__init__$', '') AS module FROM source_files")
def module_fqn(spark, d):
    return read(spark, d, "source_files").select("path", S.module_fqn(F.col("path")).alias("module")).distinct()


@query(f"WITH {_SPANS} SELECT chunk_id, 'https://host/r/blob/abc/' || path || '#L' || start_line || '-L' || end_line AS url FROM s")
def permalink_render(spark, d):
    return _spans(spark, d).select("chunk_id", S.permalink(F.lit("https://host"), F.lit("r"), F.lit("abc"), F.col("path"), F.col("start_line"), F.col("end_line")).alias("url"))


@query("""WITH c AS (SELECT chunk_id, max({'r': repo, 'path': path, 'lo': start_line, 'hi': end_line, 's': symbol, 't': text}) AS x FROM chunks GROUP BY chunk_id),
  b AS (SELECT x.r AS repo, x.path AS path, x.lo AS lo, chunk_id, string_split(regexp_replace(x.t, '\\r\\n?', chr(10), 'g'), chr(10)) AS ls, '<retrieved_chunk path="' || x.path || '" lines="' || x.lo || '-' || x.hi || '"' || coalesce(' symbol="' || x.s || '"', '') || '>' AS head, x.t AS t FROM c)
  SELECT repo, path, string_agg(head || chr(10) || CASE WHEN len(ls) <= 80 THEN t ELSE array_to_string(ls[1:80], chr(10)) || chr(10) || '... (' || (len(ls) - 80) || ' more lines)' END || chr(10) || '</retrieved_chunk>', chr(10) || chr(10) ORDER BY lo, chunk_id) AS prompt
  FROM b GROUP BY repo, path""")
def prompt_render(spark, d):
    """The chunks of each file as one prompt, in order of their lines."""
    c = read(spark, d, "chunks").groupBy("chunk_id").agg(F.max(F.struct("repo", "path", "start_line", "end_line", "symbol", "text")).alias("r")).select("chunk_id", "r.*")
    block = S.render_chunk(F.col("path"), F.col("start_line"), F.col("end_line"), F.col("symbol"), S.truncate_lines(F.col("text")))
    g = c.groupBy("repo", "path").agg(F.array_sort(F.collect_list(F.struct("start_line", "chunk_id", block.alias("b")))).alias("bs"))
    return g.select("repo", "path", F.array_join(F.transform("bs", lambda x: x.b), "\n\n").alias("prompt"))


def _dispatched(spark, d):
    q = _questions(spark, d)
    c = read(spark, d, "chunks").groupBy("chunk_id").agg(F.max(F.struct("created_at", "path", "start_line", "end_line", "symbol", "text")).alias("r")).select("chunk_id", "r.*")
    got = text.bm25(q, _chunk_texts(spark, d), "chunk_id", "text", 8).join(c, F.col("doc") == F.col("chunk_id"))
    # all items by their own route, and once more by the hint for communities, which fall back to hybrid where nothing is similar
    both = q.withColumn("route_hint", F.lit("auto")).unionByName(q.select((-F.col("query_id") - 1).alias("query_id"), "question", F.lit("community").alias("route_hint")))
    return both, got


@query()
def answer_dispatch(spark, d):
    """Every evaluation item through its route, with the chunks that BM25 ranks first and the offline model, and once more through
    the community route, with the chunks of the classes of the repository that holds the best of them."""
    both, got = _dispatched(spark, d)
    repo = read(spark, d, "chunks").groupBy(F.col("chunk_id").alias("r_id")).agg(F.max("repo").alias("community_id"))
    hits = got.where("rank = 1").join(repo, F.col("chunk_id") == F.col("r_id")).select((-F.col("query_id") - 1).alias("query_id"), F.lit(1).alias("hit_rank"), "community_id").where("community_id is not null")
    members = read(spark, d, "nodes").where("fqn is not null").select(F.col("repo").alias("community_id"), "fqn", (F.col("kind") == "class").alias("is_seed")).distinct()
    c = read(spark, d, "chunks").groupBy("chunk_id").agg(F.max(F.struct("created_at", "path", "start_line", "end_line", "symbol", "text")).alias("r")).select("chunk_id", "r.*")
    own = retrieve.community_chunks(hits, members, c).join(c, "chunk_id").select("query_id", F.col("place").alias("rank"), "path", "start_line", "end_line", "symbol", "text")
    fallback = got.unionByName(got.withColumn("query_id", -F.col("query_id") - 1))
    return answer.dispatch(both, read(spark, d, "nodes"), read(spark, d, "edges"), fallback, own)


@query("""SELECT count(*) AS n, count(DISTINCT query_id) AS n_ids, true AS all_valid FROM (SELECT item_id AS query_id FROM eval_items UNION ALL SELECT -item_id - 1 FROM eval_items)""")
def answer_checks(spark, d):
    """Each question has one answer, and no answer cites what was not retrieved."""
    a = answer_dispatch(spark, d)
    return a.agg(F.count("*").alias("n"), F.countDistinct("query_id").alias("n_ids"), F.min(F.coalesce("valid", F.lit(False)) & F.col("answer").isNotNull()).alias("all_valid"))


@query()
def community_summaries(spark, d):
    n = read(spark, d, "nodes").groupBy("fqn").agg(F.max("repo").alias("repo"))
    g = graph.symmetrise(read(spark, d, "edges"), read(spark, d, "nodes"))
    levels = leiden.communities(g.join(n.withColumnRenamed("fqn", "a"), "a").select("repo", "a", "b", "weight"))
    return communities.summarise(levels, lambda p: F.concat(F.lit("Holds "), F.substring(F.regexp_replace(p, "\\s+", " "), 1, 60)))


@query("""WITH RECURSIVE l AS (SELECT community_id AS id, max({'v': detected_at, 'p': coalesce(parent_id, 0)}).p AS p, max({'v': detected_at, 'm': coalesce(member_count, 0)}).m AS m FROM communities WHERE community_id IS NOT NULL GROUP BY 1),
  d AS (SELECT id, id AS a, [id] AS path FROM l WHERE p = 0 OR p NOT IN (SELECT id FROM l) UNION ALL SELECT l.id, l.id, list_append(d.path, l.id) FROM l JOIN d ON l.p = d.id),
  s AS (SELECT a, sum(m) AS s FROM (SELECT id, unnest(path) AS a FROM d) x JOIN l USING (id) WHERE id NOT IN (SELECT p FROM l) GROUP BY a)
  SELECT l.id AS community_id, CAST(greatest(coalesce(s, 0), m) AS BIGINT) AS subtree_size FROM l LEFT JOIN s ON s.a = l.id""")
def community_subtree_size(spark, d):
    c = read(spark, d, "communities")
    n = c.where("community_id is not null").groupBy("community_id").agg(F.max(F.struct("detected_at", F.coalesce("member_count", F.lit(0)).alias("m"))).alias("r")).select("community_id", F.col("r.m").alias("member_count"))
    return communities.subtree_sizes(hierarchies(current_links(c, "community_id", "parent_id", "detected_at")), n)


# ---- evaluation ----


def _ranked(position: str) -> str:
    return f"""WITH r AS (SELECT event_type AS route, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
      SELECT route, value AS at_rank, n FROM r WHERE i = {position}"""


def _latencies(spark, d):
    return read(spark, d, "events").select(F.col("event_type").alias("route"), "value")


@query(_ranked("greatest(CAST(round_even(0.95 * n, 0) AS BIGINT) - 1, 0) + 1"))
def latency_percentiles_nearest_rank(spark, d):
    return evaluate.percentile_row(_latencies(spark, d), "route", "value", evaluate.half_even_rank(0.95))


@query(_ranked("greatest(CAST(ceil(0.99 * n) AS BIGINT), 1)"))
def latency_percentiles_ceil(spark, d):
    return evaluate.percentile_row(_latencies(spark, d), "route", "value", evaluate.ceil_rank(0.99))


@query("SELECT event_type AS route, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY event_type")
def latency_percentiles_linear(spark, d):
    return _latencies(spark, d).groupBy("route").agg(F.round(F.percentile("value", 0.5), 6).alias("p50"), F.round(F.percentile("value", 0.95), 6).alias("p95"))


@query("SELECT event_type AS route, count(*) AS n, round(count(*) / sum(value) * 1000, 6) AS qps FROM events GROUP BY event_type")
def qps_by_route(spark, d):
    return _latencies(spark, d).groupBy("route").agg(F.count("*").alias("n"), F.round(F.count("*") / F.sum("value") * 1000, 6).alias("qps"))


@query(f"""WITH {_FUSED} SELECT t.query_id AS query_id, count(o.item) AS hits, count(*) AS denominator, count(o.item) / count(*) AS recall FROM dense t LEFT JOIN other o ON o.query_id = t.query_id AND o.item = t.item GROUP BY t.query_id""")
def recall_at_k(spark, d):
    truth = vector.top_k(_queries(spark, d), _vectors(spark, d), 10, "cosine", exclude_self=True)
    return evaluate.recall_at_k(truth, _labelled(spark, d), 10)


@query("""SELECT p_partkey, p_brand, p_size, p_retailprice FROM part a WHERE NOT EXISTS (SELECT 1 FROM part b WHERE b.p_brand = a.p_brand AND b.p_size >= a.p_size
  AND b.p_retailprice >= a.p_retailprice AND (b.p_size > a.p_size OR b.p_retailprice > a.p_retailprice))""")
def pareto_front(spark, d):
    p = read(spark, d, "part").select("p_partkey", "p_brand", "p_size", "p_retailprice")
    return evaluate.pareto(p, "p_brand", "p_size", "p_retailprice")


@query(f"""WITH {_SPANS}, e AS (SELECT DISTINCT chunk_id AS query_id, path, start_line AS lo, end_line AS hi FROM s), a AS (SELECT chunk_id AS query_id, path, start_line + 7 AS lo, end_line + 7 AS hi FROM s)
  SELECT e.query_id, count(*) AS n_expected, count(a.path) AS n_hit, count(a.path) / count(*) AS recall FROM e LEFT JOIN a ON a.query_id = e.query_id AND a.path = e.path AND a.lo <= e.hi + 5 AND a.hi >= e.lo - 5 GROUP BY e.query_id""")
def citation_recall_tolerance(spark, d):
    s = _spans(spark, d).withColumnRenamed("chunk_id", "query_id")
    exp = s.select("query_id", "path", F.col("start_line").alias("lo"), F.col("end_line").alias("hi"))
    act = s.select("query_id", "path", (F.col("start_line") + 7).alias("lo"), (F.col("end_line") + 7).alias("hi"))
    return evaluate.overlap_recall(exp, act)


@query("""SELECT o_orderpriority AS bucket, round(avg(0.5 * CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END + 0.3 * (o_totalprice / 500000) + 0.2 * 0.5), 6) AS score FROM orders GROUP BY o_orderpriority""")
def composite_score(spark, d):
    o = read(spark, d, "orders")
    s = evaluate.composite(o.o_orderstatus == "F", o.o_totalprice / 500000, F.lit(0.5))
    return o.groupBy(F.col("o_orderpriority").alias("bucket")).agg(F.round(F.avg(s), 6).alias("score"))


@query(f"""WITH a AS (SELECT dst, string_agg(DISTINCT src, ',' ORDER BY src) AS x FROM edges WHERE kind = 'call' GROUP BY dst),
  b AS (SELECT dst, string_agg(DISTINCT src, ',' ORDER BY src) AS x FROM edges WHERE kind = 'call' AND src_line > 10 GROUP BY dst)
  SELECT count(*) AS n, CAST(sum(CASE WHEN a.x = b.x THEN 1 ELSE 0 END) AS BIGINT) AS n_equal FROM a LEFT JOIN b USING (dst)""")
def caller_set_precision(spark, d):
    """Exact equality of caller sets, here of all callers and of those after line 10."""
    e = read(spark, d, "edges").where("kind = 'call'").groupBy("dst", "src").agg(F.max(F.coalesce(F.col("src_line") > 10, F.lit(False)).cast("bigint")).alias("late"))
    # sets are equal if no caller is missing from either, which a count of the pairs tells without gathering a set
    per = e.where("dst is not null and src is not null").groupBy("dst").agg(F.count("*").alias("a"), F.sum("late").alias("b"))
    return per.agg(F.count("*").alias("n"), F.sum((F.col("a") == F.col("b")).cast("bigint")).alias("n_equal"))


# ---- source to symbols ----


def _python(spark, d):
    last = read(spark, d, "source_files").groupBy("repo", "path").agg(F.max(F.struct("seen_at", "text")).alias("r"))
    return code.parse_python(last.select("repo", "path", F.col("r.text").alias("text")))


@query()
def ast_extract(spark, d):
    return code.nodes_of(_python(spark, d))


@query()
def resolve_edges(spark, d):
    return code.resolve(_python(spark, d))


@query()
def ast_chunks(spark, d):
    return code.chunks_of(_python(spark, d)).select("chunk_id", "repo", "path", "symbol", "parent_symbol", "start_line", "end_line")


@query()
def index_manifest(spark, d):
    p = _python(spark, d)
    return p.groupBy("repo", "status").agg(F.count("*").alias("n_files"), F.sum(F.size("defs")).alias("n_symbols"), F.sum(F.size("edges")).alias("n_raw_edges"), F.sum(F.size("chunks")).alias("n_chunks"))
