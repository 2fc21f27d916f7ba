"""Queries of the general data problems: hierarchies (p1), changed records (p2), dangling references (p3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.changes import ChangeFeed, latest_by, trusted_state
from millrace.operators.hierarchy import current_links, descendants, hierarchies, loop_hierarchies, outcomes
from millrace.operators.orphans import live_keys, orphan_counts, orphan_references
from millrace.queries.tables import read
from millrace.session import fresh_path, written


def _tree(spark: SparkSession, d: str) -> DataFrame:
    links = current_links(read(spark, d, "communities"), "community_id", "parent_id", "detected_at")
    return hierarchies(links)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    links = current_links(read(spark, d, "communities"), "community_id", "parent_id", "detected_at")
    return outcomes(links).where("outcome <> 'root'").select(F.col("id").alias("community_id"), "outcome")


def p1_paths(spark: SparkSession, d: str) -> DataFrame:
    t = _tree(spark, d).where("path is not null")
    return t.select(
        F.col("id").alias("community_id"),
        F.col("root_id"),
        F.col("depth"),
        F.concat_ws("/", F.col("path").cast("array<string>")).alias("full_path"),
        "n_descendants",
    )


def p1_descendants(spark: SparkSession, d: str) -> DataFrame:
    return descendants(written(_tree(spark, d), "tree"))


def p1_loop_paths(spark: SparkSession, d: str) -> DataFrame:
    """What p1_paths leaves out: the communities on and under loops, from the top that is left when each loop is cut."""
    t = loop_hierarchies(_tree(spark, d))
    path = F.concat_ws("/", F.col("path").cast("array<string>")).alias("full_path")
    return t.select(F.col("id").alias("community_id"), "root_id", "depth", path, "n_descendants", "outcome", "cycle_id")


def p1_loop_descendants(spark: SparkSession, d: str) -> DataFrame:
    """What p1_descendants leaves out: the pairs on and under loops."""
    return descendants(written(loop_hierarchies(_tree(spark, d)), "loop_tree"))


def p1_back_edges(spark: SparkSession, d: str) -> DataFrame:
    t = _tree(spark, d).where("is_back_edge")
    return t.select(F.col("id").alias("community_id"), "parent_id", "cycle_id")


_FILE = ["repo", "path"]


def _feed(spark: SparkSession, d: str) -> ChangeFeed:
    feed = ChangeFeed(spark, fresh_path(spark, "feed"), _FILE, "file_sha")
    listing = latest_by(read(spark, d, "source_files").drop("text"), _FILE, ["seen_at"], ["file_sha"])
    feed.capture(listing, trusted_state(read(spark, d, "file_meta"), read(spark, d, "index_runs"), _FILE, "file_sha", "last_indexed_at"))
    return feed


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    feed = _feed(spark, d)
    feed.run()
    return feed.processed().select(*_FILE)


def p2_batches(spark: SparkSession, d: str) -> DataFrame:
    """How many files each run took up: a first run that breaks off after its sink, its replay, and a run that finds nothing."""
    feed = _feed(spark, d)
    try:
        feed.run(fail_after="sink")
    except RuntimeError:
        pass
    feed.run()
    feed.run()
    return feed.processed().groupBy("repo").agg(F.count("*").alias("n_files"), F.countDistinct("path").alias("n_paths"))


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    nodes = live_keys(read(spark, d, "nodes"), "fqn", "indexed_at", "deleted_at")
    external = read(spark, d, "external_symbols").select(F.col("fqn").alias("key"))
    placeholder = (F.col("ref_key") == "<anonymous>") | (F.col("ref_key").startswith("<unresolved:") & F.col("ref_key").endswith(">"))
    edges = orphan_references(read(spark, d, "edges"), "edges", ["src", "dst"], [nodes, external], "indexed_at", placeholder)
    chunks = read(spark, d, "chunks").select(F.col("chunk_id").alias("key"))
    vectors = orphan_references(read(spark, d, "chunk_embeddings"), "chunk_embeddings", ["chunk_id"], [chunks], "created_at")
    return edges.unionByName(vectors)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select("table_name", "column_name", "ref_key", "ref_month")


def p3_counts(spark: SparkSession, d: str) -> DataFrame:
    return orphan_counts(_orphans(spark, d))


QUERIES = {f.__name__: f for f in (p1_found, p1_paths, p1_descendants, p1_loop_paths, p1_loop_descendants, p1_back_edges, p2_found, p2_batches, p3_found, p3_counts)}

_LINKS = """links AS (SELECT community_id AS id, CASE WHEN r.p = 0 THEN NULL ELSE r.p END AS p FROM (
  SELECT community_id, max({'v': detected_at, 'p': coalesce(parent_id, 0)}) AS r FROM communities
  WHERE community_id IS NOT NULL GROUP BY community_id))"""
_DOWN = f"""WITH RECURSIVE {_LINKS}, down AS (
  SELECT id, CASE WHEN p IS NULL THEN id END AS root_id, 0 AS depth, CAST(id AS VARCHAR) AS full_path, [id] AS path,
    CASE WHEN p IS NULL THEN 'root' ELSE 'lost_parent' END AS outcome
  FROM links WHERE p IS NULL OR p NOT IN (SELECT id FROM links)
  UNION ALL
  SELECT l.id, d.root_id, d.depth + 1, d.full_path || '/' || CAST(l.id AS VARCHAR), list_append(d.path, l.id), d.outcome
  FROM links l JOIN down d ON l.p = d.id)"""
_LOOPS = f"""{_DOWN}, rest AS (SELECT * FROM links WHERE id NOT IN (SELECT id FROM down)),
  hop AS (SELECT id AS start, p AS here, 1 AS n FROM rest UNION ALL
    SELECT h.start, r.p, h.n + 1 FROM hop h JOIN rest r ON h.here = r.id WHERE h.here <> h.start AND h.n <= (SELECT count(*) FROM rest)),
  ring AS (SELECT DISTINCT start AS id FROM hop WHERE here = start)"""
_ORPHANS = """alive AS (SELECT fqn FROM (SELECT fqn, max({'v': indexed_at, 'a': deleted_at IS NULL}) AS r FROM nodes
    WHERE fqn IS NOT NULL GROUP BY fqn) WHERE r.a),
  refs AS (SELECT 'edges' AS table_name, 'src' AS column_name, src AS ref_key, indexed_at AS t FROM edges
    UNION ALL SELECT 'edges', 'dst', dst, indexed_at FROM edges),
  orphans AS (SELECT table_name, column_name, ref_key, strftime(to_timestamp(t) AT TIME ZONE 'UTC', '%Y-%m') AS ref_month FROM refs
    WHERE ref_key IS NOT NULL AND ref_key <> '<anonymous>' AND NOT (starts_with(ref_key, '<unresolved:') AND suffix(ref_key, '>'))
      AND NOT EXISTS (SELECT 1 FROM alive WHERE fqn = ref_key) AND NOT EXISTS (SELECT 1 FROM external_symbols e WHERE e.fqn = ref_key)
    UNION ALL
    SELECT 'chunk_embeddings', 'chunk_id', chunk_id, strftime(to_timestamp(created_at) AT TIME ZONE 'UTC', '%Y-%m') FROM chunk_embeddings v
    WHERE chunk_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM chunks c WHERE c.chunk_id = v.chunk_id))"""
_CHANGED = """span AS (SELECT started_at, coalesce(lead(started_at) OVER (ORDER BY started_at), 9223372036854775807) AS until, status
    FROM (SELECT started_at, arg_max(status, run_id) AS status FROM index_runs GROUP BY started_at)),
  trusted AS (SELECT repo, path, max({'t': last_indexed_at, 's': lower(file_sha)}).s AS sha FROM file_meta JOIN span
    ON last_indexed_at >= started_at AND last_indexed_at < until WHERE status = 'success' AND file_sha IS NOT NULL GROUP BY repo, path),
  listed AS (SELECT repo, path, lower(max({'t': seen_at, 's': file_sha}).s) AS sha FROM source_files GROUP BY repo, path),
  changed AS (SELECT l.repo, l.path FROM listed l LEFT JOIN trusted t
    ON l.repo IS NOT DISTINCT FROM t.repo AND l.path IS NOT DISTINCT FROM t.path WHERE t.sha IS NULL OR l.sha IS DISTINCT FROM t.sha)"""

_CUT = f"""{_LOOPS}, low AS (SELECT start, least(start, min(here)) AS m FROM hop WHERE start IN (SELECT id FROM ring) GROUP BY start),
  cut AS (SELECT r.id, CASE WHEN r.p = w.m THEN NULL ELSE r.p END AS p FROM rest r LEFT JOIN low w ON w.start = r.id),
  tree AS (SELECT id, id AS top, 0 AS depth, CAST(id AS VARCHAR) AS full_path, [id] AS path FROM cut WHERE p IS NULL
    UNION ALL SELECT c.id, t.top, t.depth + 1, t.full_path || '/' || CAST(c.id AS VARCHAR), list_append(t.path, c.id) FROM cut c JOIN tree t ON c.p = t.id)"""

SQL = {
    "p1_loop_paths": f"""{_CUT}, below AS (SELECT id, count(*) - 1 AS n FROM (SELECT unnest(path) AS id FROM tree) GROUP BY id)
      SELECT t.id AS community_id, CAST(NULL AS BIGINT) AS root_id, depth, full_path, n AS n_descendants, CASE WHEN t.id IN (SELECT id FROM ring) THEN 'cycle' ELSE 'under_cycle' END AS outcome, m AS cycle_id
      FROM tree t JOIN below b ON b.id = t.id JOIN low ON low.start = t.top""",
    "p1_loop_descendants": f"""{_CUT} SELECT path[k] AS ancestor_id, id AS descendant_id, CAST(depth + 1 - k AS INTEGER) AS distance
      FROM (SELECT id, path, depth, unnest(range(1, depth + 1)) AS k FROM tree)""",
    "p1_found": f"""{_LOOPS} SELECT id AS community_id, outcome FROM down WHERE outcome <> 'root' UNION ALL
      SELECT id, CASE WHEN id IN (SELECT id FROM ring) THEN 'cycle' ELSE 'under_cycle' END FROM rest""",
    "p1_paths": f"""{_DOWN}, below AS (SELECT id, count(*) - 1 AS n FROM (SELECT unnest(path) AS id FROM down) GROUP BY id)
      SELECT d.id AS community_id, root_id, depth, full_path, n AS n_descendants FROM down d JOIN below b ON b.id = d.id""",
    "p1_descendants": f"""{_DOWN} SELECT path[k] AS ancestor_id, id AS descendant_id, CAST(depth + 1 - k AS INTEGER) AS distance
      FROM (SELECT id, path, depth, unnest(range(1, depth + 1)) AS k FROM down)""",
    "p1_back_edges": f"""{_LOOPS}, low AS (SELECT start, least(start, min(here)) AS m FROM hop WHERE start IN (SELECT id FROM ring) GROUP BY start)
      SELECT l.id AS community_id, l.p AS parent_id, w.m AS cycle_id FROM links l JOIN low w ON w.start = l.id WHERE l.p = w.m""",
    "p2_found": f"WITH {_CHANGED} SELECT repo, path FROM changed",
    "p2_batches": f"WITH {_CHANGED} SELECT repo, count(*) AS n_files, count(*) AS n_paths FROM changed GROUP BY repo",
    "p3_found": f"WITH {_ORPHANS} SELECT DISTINCT table_name, column_name, ref_key, ref_month FROM orphans",
    "p3_counts": f"""WITH {_ORPHANS} SELECT table_name, column_name, ref_month, count(DISTINCT ref_key) AS n_keys, count(*) AS n_rows
      FROM orphans GROUP BY table_name, column_name, ref_month""",
}
