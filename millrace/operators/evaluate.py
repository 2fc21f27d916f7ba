"""Evaluation: recall, percentiles in three conventions, rates, composite scores and Pareto fronts."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.operators import vector
from millrace.session import fresh_path, written


def percentile_row(df: DataFrame, group: str, value: str, position) -> DataFrame:
    """(group, value at a rank): `position` maps the group's size (a Column) to a rank from 1.

    Ranks come from the distinct values and their counts, added up on the map side, so that a hot group does not have to be
    sorted row by row.
    """
    c = df.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("c"))
    w = Window.partitionBy(group)
    c = c.withColumn("upto", F.sum("c").over(w.orderBy(value))).withColumn("n", F.sum("c").over(w))
    hit = c.where((F.col("upto") >= position(F.col("n"))) & (F.col("upto") - F.col("c") < position(F.col("n"))))
    return hit.select(group, F.col(value).alias("at_rank"), "n")


def half_even_rank(p: float):
    """max(round-half-even(p n) - 1, 0) as an index from 0, here from 1."""
    return lambda n: F.greatest(F.bround(F.lit(p) * n, 0).cast("bigint") - 1, F.lit(0)) + 1


def ceil_rank(p: float):
    return lambda n: F.greatest(F.ceil(F.lit(p) * n), F.lit(1))


def recall_at_k(truth: DataFrame, got: DataFrame, k: int, by_truth: bool = True) -> DataFrame:
    """(query_id, hits, denominator, recall) for truth and got (query_id, item, rank); the denominator is the size of the truth
    set, or k."""
    t = truth.where(F.col("rank") <= k).select("query_id", "item")
    g = got.where(F.col("rank") <= k).select("query_id", "item", F.lit(1).alias("hit")).distinct()
    j = t.join(g, ["query_id", "item"], "left").groupBy("query_id").agg(F.count("hit").alias("hits"), F.count("*").alias("n"))
    d = F.col("n") if by_truth else F.lit(k).cast("bigint")
    return j.select("query_id", "hits", d.alias("denominator"), (F.col("hits") / d).alias("recall"))


def composite(grounded: Column, path_recall: Column, citation_recall: Column) -> Column:
    return 0.5 * grounded.cast("double") + 0.3 * path_recall + 0.2 * citation_recall


def pareto(df: DataFrame, group: str, x: str, y: str) -> DataFrame:
    """Rows that no other row of their group beats in one of x, y without losing in the other; equal rows all stay.

    By running maxima over the distinct points in descending x, not by comparing all pairs: a point stays if its y is the
    greatest of its x and exceeds all y of greater x.
    """
    best = df.groupBy(group, x).agg(F.max(y).alias("_y"))
    above = Window.partitionBy(group).orderBy(F.col(x).desc()).rowsBetween(Window.unboundedPreceding, -1)
    front = best.withColumn("_above", F.max("_y").over(above)).where(F.col("_above").isNull() | (F.col("_y") > F.col("_above")))
    f = front.select(F.col(group).alias("_g"), F.col(x).alias("_x"), "_y")
    return df.join(f, (df[group] == f["_g"]) & (df[x] == f["_x"]) & (df[y] == f["_y"]), "left_semi")


def overlap_recall(expected: DataFrame, actual: DataFrame, tolerance: int = 5) -> DataFrame:
    """(query_id, n_expected, n_hit, recall) of citations (query_id, path, lo, hi): an expected one counts if an actual one of the
    same path overlaps it within `tolerance` lines. Questions without expectations are not in the result; they count 1."""
    a = actual.select(F.col("query_id").alias("a_q"), F.col("path").alias("a_p"), F.col("lo").alias("a_lo"), F.col("hi").alias("a_hi"))
    e = expected.distinct()
    on = (F.col("query_id") == F.col("a_q")) & (F.col("path") == F.col("a_p")) & (F.col("a_lo") <= F.col("hi") + tolerance) & (F.col("a_hi") >= F.col("lo") - tolerance)
    hit = e.join(a, on, "left_semi").groupBy("query_id").agg(F.count("*").alias("n_hit"))
    n = e.groupBy("query_id").agg(F.count("*").alias("n_expected"))
    j = n.join(hit, "query_id", "left").withColumn("n_hit", F.coalesce("n_hit", F.lit(0)))
    return j.withColumn("recall", F.col("n_hit") / F.col("n_expected"))


def hit_paths(found: Column, cited: Column) -> Column:
    """The distinct paths of retrieved chunks and of citations, nulls left out."""
    some = lambda c: F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda x: x.isNotNull())
    return F.array_union(some(found), some(cited))


def sweep(queries: DataFrame, base: DataFrame, ms: tuple[int, ...], builds: tuple[int, ...], searches: tuple[int, ...], k: int = 10, metric: str = "cosine") -> DataFrame:
    """(m, ef_build, ef_search, recall, qps, build_s, on_front) of a stored vector index over a grid of settings; on_front marks
    rows that none beats in recall and speed together."""
    spark = base.sparkSession
    truth = written(vector.top_k(queries, base, k, metric), "truth")
    n, dim = queries.count(), len(base.where("vector is not null").select("vector").first().vector)
    rows = []
    for m in ms:
        for ef_build in builds:
            index = vector.VectorIndex.create(spark, fresh_path(spark, "sweep"), dim, metric, None, m, ef_build)
            t = time.monotonic()
            index.add(base)
            build = time.monotonic() - t
            for ef in searches:
                t = time.monotonic()
                got = written(index.search(queries, k, ef), "found")
                took = time.monotonic() - t
                recall = recall_at_k(truth, got, k).agg(F.avg("recall")).first()[0]
                rows.append((m, ef_build, ef, float(recall or 0), n / took, build))
            index.drop()
    df = spark.createDataFrame(rows, "m int, ef_build int, ef_search int, recall double, qps double, build_s double").withColumn("_all", F.lit(1))
    front = pareto(df, "_all", "recall", "qps").select("m", "ef_build", "ef_search", F.lit(True).alias("on_front"))
    return df.join(front, ["m", "ef_build", "ef_search"], "left").withColumn("on_front", F.coalesce("on_front", F.lit(False))).drop("_all")


def question_report(answers: DataFrame, expected: DataFrame) -> DataFrame:
    """(query_id, grounded, path_recall, citation_recall, score) for answers (query_id, answer, valid, found: array of paths) and
    expected (query_id, paths: array, path, lo, hi), the driver of answer evaluation. What nobody expects counts 1."""
    from millrace.functions.scalars import valid_citations

    paths = expected.groupBy("query_id").agg(F.array_distinct(F.flatten(F.collect_list("paths"))).alias("want"))
    a = answers.join(paths, "query_id", "left").withColumn("cites", valid_citations(F.col("answer")))
    hits = hit_paths(F.col("found"), F.transform("cites", lambda c: c.path))
    share = F.when(F.coalesce(F.size("want"), F.lit(0)) < 1, 1.0).otherwise(F.size(F.array_intersect(hits, "want")) / F.size("want"))
    got = a.select("query_id", F.explode("cites").alias("c")).select("query_id", "c.path", "c.lo", "c.hi")
    over = overlap_recall(expected.where("path is not null").select("query_id", "path", "lo", "hi"), got).select("query_id", F.col("recall").alias("cited"))
    j = a.select("query_id", F.coalesce("valid", F.lit(False)).alias("grounded"), share.alias("path_recall")).join(over, "query_id", "left")
    j = j.select("query_id", "grounded", "path_recall", F.coalesce("cited", F.lit(1.0)).alias("citation_recall"))
    return j.withColumn("score", composite(F.col("grounded"), F.col("path_recall"), F.col("citation_recall")))


def caller_report(questions: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, symbol, n_expected, n_found, n_both, exact) for questions (id, symbol, expected: array of names): the callers found by
    the graph against those expected, by counts of pairs, so that no set of callers is gathered."""
    from millrace.operators.graph import callers, suffix_lookup

    q = questions.select("id", "symbol", F.array_distinct(F.coalesce("expected", F.array().cast("array<string>"))).alias("expected"))
    hit = suffix_lookup(q.select(F.col("id").alias("query_id"), "symbol"), nodes)
    got = callers(hit, edges).where("caller is not null").select(F.col("query_id").alias("id"), F.col("caller").alias("name")).distinct().withColumn("found", F.lit(1))
    want = q.select("id", F.explode("expected").alias("name")).withColumn("wanted", F.lit(1))
    both = want.join(got, ["id", "name"], "full_outer").groupBy("id").agg(F.count("found").alias("n_found"), F.sum((F.col("found").isNotNull() & F.col("wanted").isNotNull()).cast("bigint")).alias("n_both"))
    out = q.select("id", "symbol", F.size("expected").cast("bigint").alias("n_expected")).join(both, "id", "left")
    out = out.withColumn("n_found", F.coalesce("n_found", F.lit(0))).withColumn("n_both", F.coalesce("n_both", F.lit(0)))
    return out.withColumn("exact", (F.col("n_found") == F.col("n_expected")) & (F.col("n_both") == F.col("n_expected")))
