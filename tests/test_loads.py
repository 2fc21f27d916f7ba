import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import answer, evaluate, retrieve, text, vector
from millrace.operators.index import CodeIndex
from millrace.session import fresh_path
from millrace.sources import bench
from millrace.streaming import loads


def test_bulk_load_in_flushes(spark, tmp_path):
    index = vector.VectorIndex.create(spark, fresh_path(spark, "v"), 8, "l2", shard_rows=50)
    folder, checkpoint = str(tmp_path / "in"), str(tmp_path / "cp")
    base = vector.synthetic(spark, 120, 8)
    for part in (base.where("item < 60"), base.where("item >= 40")):
        part.coalesce(1).write.mode("append").json(folder)
        loads.bulk_load(spark, folder, index, checkpoint, 1).awaitTermination()
    assert index.count() == 120 and index.batches() == [0, 1]
    q = base.where("item % 10 = 0").withColumnRenamed("item", "query_id")
    got = {r.query_id: r.item for r in index.search(q, 1, 128).collect()}
    assert got == {i: i for i in range(0, 120, 10)}
    loads.bulk_load(spark, folder, index, str(tmp_path / "again"), 10).awaitTermination()  # a lost checkpoint: flush 0 is marked as done
    assert index.count() == 120
    spark.createDataFrame([(1, [1.0])], "item bigint, vector array<float>").write.mode("append").json(folder)
    with pytest.raises(Exception, match="vector of length 1"):
        loads.bulk_load(spark, folder, index, checkpoint, 1).awaitTermination()


def test_reindex_keeps_other_repositories(spark, tmp_path):
    index = CodeIndex(spark, fresh_path(spark, "index"))
    folder, checkpoint = str(tmp_path / "in"), str(tmp_path / "cp")

    def listing(rows):
        spark.createDataFrame(rows, loads.LISTING).coalesce(1).write.mode("append").json(folder)
        loads.reindex(spark, folder, index, checkpoint).awaitTermination()

    listing([("a", "x.py", "def f(): pass", "1", 1), ("b", "y.py", "def g(): pass", "2", 1), (None, "z.py", "k = 1", "3", 1)])
    listing([("a", "x.py", "old", "0", 1), ("a", "x.py", "def h(): pass", "4", 2)])
    assert {(r.repo, r.fqn) for r in index.nodes().collect()} == {("a", "x"), ("a", "x.h"), ("b", "y"), ("b", "y.g"), (None, "z")}
    listing([("b", "new.py", "", "5", 1)])
    assert {(r.repo, r.path) for r in index.live().collect()} == {("a", "x.py"), ("b", "new.py"), (None, "z.py")}


def test_question_and_bench_files(spark, tmp_path):
    (tmp_path / "q.jsonl").write_text('{"id": "1", "question": "who?", "expected": ["a.b"]}\n\n  \n{"id": "2", "expected_citations": [{"path": "p", "lines": [1, 2]}]}\nnot json\n')
    got = bench.load_questions(spark, str(tmp_path / "q.jsonl")).collect()
    assert [(r.id, r.question, r.expected) for r in got] == [("1", "who?", ["a.b"]), ("2", None, None), (None, None, None)] and got[1].expected_citations[0].lines == [1, 2]
    (tmp_path / "b.csv").write_text("index,M,recall,qps\nhnsw,16.0,0.95,\n,1,1,1\nflat,,1.0,3.5\n")
    rows = {r["index"]: r for r in bench.read_bench(spark, str(tmp_path / "b.csv")).collect()}
    assert set(rows) == {"hnsw", "flat"} and rows["hnsw"].M == 16 and rows["hnsw"].qps == 0 and rows["flat"].M == 0 and rows["flat"].dim == 0
    out = str(tmp_path / "out")
    for _ in range(2):
        bench.write_bench(bench.read_bench(spark, str(tmp_path / "b.csv")), out)
    assert bench.read_bench(spark, out).count() == 4
    (tmp_path / "empty.csv").write_text("index,M\n")
    assert bench.read_bench(spark, str(tmp_path / "empty.csv")).count() == 0


def test_sift_files(spark, tmp_path):
    rng = np.random.default_rng(0)
    base, queries = rng.standard_normal((40, 4)).astype("f4"), rng.standard_normal((3, 4)).astype("f4")
    near = np.argsort(((queries[:, None] - base[None]) ** 2).sum(2), axis=1)[:, :5]
    for name, rows, kind in (("base.fvecs", base, "f"), ("query.fvecs", queries, "f"), ("groundtruth.ivecs", near, "i")):
        (tmp_path / name).write_bytes(b"".join(struct.pack(f"<i{len(r)}{kind}", len(r), *r.tolist()) for r in rows))
    b, q, truth = bench.load_sift(spark, str(tmp_path), k=5)
    assert {(r.query_id, r.rank): r.item for r in truth.collect()} == {(i, j + 1): int(near[i, j]) for i in range(3) for j in range(5)}
    b, q, truth = bench.load_sift(spark, str(tmp_path), max_base=10, max_queries=2, k=2)
    assert b.count() == 10 and q.count() == 2 and truth.count() == 4 and truth.agg(F.max("item")).first()[0] < 10
    with pytest.raises(FileNotFoundError):
        bench.load_sift(spark, str(tmp_path / "none"))


def test_questions_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(1)
    words = [f"w{chr(97 + i)}x" for i in range(20)]
    docs = spark.createDataFrame([(i, " ".join(rng.choice(words, 12))) for i in range(60)], "id bigint, text string")
    q = spark.createDataFrame([(i, " ".join(rng.choice(words, 5))) for i in range(9)] + [(99, "??")], "query_id bigint, question string")
    whole = sorted(map(tuple, text.bm25(q, docs, "id", "text", 5).collect()))
    monkeypatch.setattr(text, "MOST_WEIGHTS", 30)
    assert sorted(map(tuple, text.bm25(q, docs, "id", "text", 5).collect())) == whole and len(whole) > 30
    assert evaluate.sweep(q.limit(0).selectExpr("query_id", "array(1f) as vector"), vector.synthetic(spark, 60, 1), (4,), (10,), (16,), 3, "l2").count() == 1


def test_models_are_columns(spark):
    df = spark.createDataFrame([(1, "q", "a", "xx", 1), (1, "q", "b", "xxxx", 2), (1, "q", "c", None, 3)], "query_id int, question string, item string, text string, rank int")
    got = retrieve.rerank_by(df, 3, lambda q, t: F.length(t)).orderBy("new_rank").collect()
    assert [r.item for r in got] == ["b", "a", "c"]
    v = df.select(vector.embed_by(F.col("text"), lambda: lambda ts: [[len(t), 0.0] for t in ts], 2).alias("v")).collect()
    assert [r.v for r in v] == [[1.0, 0.0], [1.0, 0.0], None]
    with pytest.raises(Exception, match="length 1, not 2"):
        df.select(vector.embed_by(F.col("text"), lambda: lambda ts: [[1.0] for _ in ts], 2)).collect()
    p = df.limit(1).select(answer.router_prompt(F.col("question")).alias("r"), answer.community_prompt(F.col("question"), F.lit("C"), F.lit("B")).alias("c"), answer.reduce_prompt(F.array(F.lit("one"), F.lit("two"))).alias("d")).first()
    assert p.r.endswith("Question: q") and "C\n\nB\n\nQuestion: q" in p.c and p.d.endswith("one\n\ntwo")
    with pytest.raises(Exception, match="no summaries"):
        df.select(answer.reduce_prompt(F.array().cast("array<string>"))).collect()


def test_caller_report(spark):
    nodes = spark.createDataFrame([("m.C.f",), ("m.g",), ("m.h",)], "fqn string")
    edges = spark.createDataFrame([("m.g", "m.C.f", "call", "m.py", 1, 1, 1), ("m.h", "m.C.f", "call", "m.py", 2, 1, 1), ("m.h", "m.C.f", "call", "m.py", 9, 1, 1)], "src string, dst string, kind string, src_path string, src_line int, weight int, indexed_at bigint")
    q = spark.createDataFrame([("1", "C.f", ["m.g", "m.h"]), ("2", "C.f", ["m.g"]), ("3", "g", None), ("4", "g", ["x"])], "id string, symbol string, expected array<string>")
    got = {r.id: (r.n_expected, r.n_found, r.n_both, r.exact) for r in evaluate.caller_report(q, nodes, edges).collect()}
    assert got == {"1": (2, 2, 2, True), "2": (1, 2, 1, False), "3": (0, 0, 0, True), "4": (1, 0, 0, False)}
