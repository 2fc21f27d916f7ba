from pyspark.sql import functions as F

from millrace.operators.orphans import live_keys, orphan_counts, orphan_references


def test_orphans(spark):
    nodes = spark.createDataFrame([("a", 1, None), ("b", 1, None), ("b", 2, 5), ("c", 3, None), ("c", 2, 9), (None, 1, None), ("t", 4, None), ("t", 4, 4)], "fqn string, indexed_at bigint, deleted_at bigint")
    live = live_keys(nodes, "fqn", "indexed_at", "deleted_at")
    assert sorted(r.key for r in live.collect()) == ["a", "c", "t"]
    edges = spark.createDataFrame(
        [("a", "b", 0, 1), ("a", "b", 0, 1), ("a", "b", 40 * 86400, 2), ("A", None, 0, 3), ("c", "<anonymous>", 0, 4), ("c", "<unresolved:x>", 0, 5), ("ext", "<unresolved:x", None, 6)],
        "src string, dst string, indexed_at bigint, ref_key int",
    )
    ext = spark.createDataFrame([("ext",)], "key string")
    ignore = (F.col("ref_key") == "<anonymous>") | (F.col("ref_key").startswith("<unresolved:") & F.col("ref_key").endswith(">"))
    got = orphan_references(edges, "edges", ["src", "dst"], [live, ext], "indexed_at", ignore)
    rows = sorted((r.column_name, r.ref_key, r.ref_month, r.n_rows) for r in got.collect())
    assert rows == [("dst", "<unresolved:x", None, 1), ("dst", "b", "1970-01", 2), ("dst", "b", "1970-02", 1), ("src", "A", "1970-01", 1)]
    counts = {(r.column_name, r.ref_month): (r.n_keys, r.n_rows) for r in orphan_counts(got).collect()}
    assert counts["dst", "1970-01"] == (1, 2)
    assert orphan_references(edges.limit(0), "edges", ["src"], [live], "indexed_at").count() == 0
    assert orphan_references(edges, "edges", ["src"], [live.limit(0)], "indexed_at").count() == 5  # a in two months, A, c, ext
