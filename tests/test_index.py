import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions import scalars as S
from millrace.operators import evaluate, vector
from millrace.operators.index import CodeIndex
from millrace.session import fresh_path
from millrace.sources.files import SKIPPED, read_tree


def tree(spark, files):
    rows = [(repo, path, text, None if text is None else str(abs(hash(text)))) for repo, path, text in files]
    return spark.createDataFrame(rows, "repo string, path string, text string, file_sha string")


def counts(manifest):
    return {(r.repo, r.change, r.status): (r.n_files, r.n_symbols) for r in manifest.collect()}


FIRST = [("r", "keep.py", "def f():\n    g()\n"), ("r", "gone.py", "def h(): pass\n"), ("r", "pkg/__init__.py", ""), ("r", "pkg/a.py", "class A:\n    def m(self):\n        self.m()\n"), (None, "n.py", "x = 1\n"), ("r", "web.ts", "let a"), ("r", "README.md", "hi"), ("r", "bad.py", "def (")]


def rows_of(index):
    return {n: sorted(map(str, getattr(index, n)().collect())) for n in ("nodes", "edges", "chunks")}


def test_second_run_reads_what_changed_and_equals_a_rebuild(spark):
    index = CodeIndex(spark, fresh_path(spark, "index"))
    first = counts(index.run(tree(spark, FIRST)))
    assert first["r", "added", "ok"][0] == 4 and first["r", "added", "unsupported"] == (1, 0) and first["r", "added", "no language"] == (1, 0) and first["r", "added", "parse_error"] == (1, 1) and first[None, "added", "ok"][0] == 1
    again = counts(index.run(tree(spark, FIRST)))
    assert {k[1:] for k in again} == {("unchanged", "cached")} and sum(n for n, _ in again.values()) == 8
    now = [f for f in FIRST if f[1] != "gone.py" and f[1] != "keep.py"] + [("r", "keep.py", ""), ("r", "new.py", "import keep\n"), ("r", None, "x")]
    got = counts(index.run(tree(spark, now)))
    assert got["r", "deleted", None] == (1, 0) and got["r", "modified", "ok"] == (1, 1) and got["r", "added", "ok"] == (1, 1)
    whole = CodeIndex(spark, fresh_path(spark, "index"))
    whole.run(tree(spark, now))
    assert rows_of(index) == rows_of(whole)
    assert any("pkg.a" in x and "def" in x for x in rows_of(index)["edges"])  # a package keeps its definition edge
    index.compact()
    assert rows_of(index) == rows_of(whole) and len(index.runs()) == 1
    forced = counts(index.run(tree(spark, now), force=True))
    assert forced["r", "unchanged", "ok"][0] == 4 and rows_of(index) == rows_of(whole)


def test_a_run_that_breaks_off_leaves_no_trace(spark, monkeypatch):
    from millrace.operators import code

    index = CodeIndex(spark, fresh_path(spark, "index"))
    index.run(tree(spark, FIRST))
    before = rows_of(index)
    with monkeypatch.context() as m:
        m.setattr(code, "chunks_of", lambda p: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            index.run(tree(spark, []))
    assert rows_of(index) == before
    assert counts(index.run(tree(spark, [])))["r", "deleted", None][0] == 7 and rows_of(index)["nodes"] == []


def test_vector_index(spark):
    base, q = vector.synthetic(spark, 1024, 32), vector.synthetic(spark, 50, 32, seed=2).withColumnRenamed("item", "query_id")
    index = vector.VectorIndex.create(spark, fresh_path(spark, "v"), 32, "l2", "m", shard_rows=400)
    assert index.search(q, 5).count() == 0 and index.count() == 0
    index.add(base.where("item < 600").withColumn("vector", F.transform("vector", lambda x: x + 9)))
    index.add(base.where("item >= 300"))
    index.add(base.where("item < 300").unionByName(spark.createDataFrame([(None, [0.0] * 32), (7777, None)], "item bigint, vector array<float>")))
    truth = vector.top_k(q, base, 5, "l2")
    for x in (index, vector.VectorIndex(spark, index.folder), index.snapshot(fresh_path(spark, "v"))):
        assert x.count() == 1024
        assert evaluate.recall_at_k(truth, x.search(q, 5), 5).agg(F.sum("hits")).first()[0] >= 0.96 * 250
    with pytest.raises(Exception, match="vector of length 3"):
        index.add(spark.createDataFrame([(1, [1.0, 2.0, 3.0])], "item bigint, vector array<float>"))
    assert index.count() == 1024  # a refused batch leaves nothing
    with pytest.raises(ValueError):
        index.check(32, "other")
    with pytest.raises(FileExistsError):
        vector.VectorIndex.create(spark, index.folder, 32)
    with pytest.raises(FileNotFoundError):
        vector.VectorIndex(spark, fresh_path(spark, "none"))
    with pytest.raises(ValueError):
        vector.VectorIndex.create(spark, fresh_path(spark, "v"), 0)


def test_bulk_graph_is_stored_and_reached():
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.standard_normal((40, 8)) * 0.01 + 10 * c for c in rng.standard_normal((30, 8))])
    for metric in ("l2", "cosine"):
        g = vector.Hnsw(4, 20, metric).build([f"k{i}" for i in range(len(x))] + ["k0"], np.vstack([x, x[0]]))
        assert len(g.ids) == len(x)
        same = vector.Hnsw.from_bytes(g.to_bytes())
        for i in range(0, len(x), 40):
            assert same.search(x[i], 3, 64) == g.search(x[i], 3, 64)
            assert g.search(x[i], 1, 64)[0][0] < 1e-9
    assert vector.Hnsw().build([], np.zeros((0, 2))).search([1.0, 0.0], 1) == []
    one = vector.Hnsw().build(["a"], np.ones((1, 2)))
    one.add("b", [1.0, -1.0])
    assert [k for _, k in one.search([1.0, -1.0], 2)] == ["b", "a"]


def test_files_that_cannot_be_read_are_listed(spark, tmp_path):
    for p in ("bin/a.py", "vendor/b.go", "out/c.js", "deep/er/and/er/d.py", ".git/no.py", "dist/no.py", "x/node_modules/no.js"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("x")
    (tmp_path / "loop").symlink_to(tmp_path / "nowhere")
    got = {r.path: r for r in read_tree(spark, str(tmp_path)).collect()}
    assert {p for p, r in got.items() if r.content is not None} == {"bin/a.py", "vendor/b.go", "out/c.js", "deep/er/and/er/d.py"}
    assert "vendor" not in SKIPPED


def test_evaluation_and_summaries(spark):
    said = ['Sure:\n{"title": "T", "summary": "S"}', "First line\nmore", "", None, '{"title": "T"}']
    df = spark.createDataFrame([(i, x) for i, x in enumerate(said)], "id int, raw string").select("id", S.parse_summary(F.col("raw")).alias("p"))
    got = {r.id: (r.p.title, r.p.summary) for r in df.collect()}
    assert got == {0: ("T", "S"), 1: ("First line", "First line\nmore"), 2: ("", ""), 3: ("", ""), 4: ('{"title": "T"}', '{"title": "T"}')}
    names = spark.createDataFrame([("ollama/llama",), ("x",), (None,)], "m string").select(S.without_provider(F.col("m")).alias("a"), S.has_provider(F.col("m")).alias("b")).collect()
    assert [(r.a, r.b) for r in names] == [("llama", True), ("x", False), (None, False)]
    answers = spark.createDataFrame([(1, "see [a.py:1-9]", True, ["b.py"]), (2, None, None, None)], "query_id int, answer string, valid boolean, found array<string>")
    expected = spark.createDataFrame([(1, ["a.py", "c.py"], "a.py", 5, 6), (1, ["a.py", "c.py"], "a.py", 90, 95)], "query_id int, paths array<string>, path string, lo int, hi int")
    rep = {r.query_id: r for r in evaluate.question_report(answers, expected).collect()}
    assert rep[1].path_recall == 0.5 and rep[1].citation_recall == 0.5 and abs(rep[1].score - 0.75) < 1e-9 and rep[2].score == 0.5
    assert json.dumps(sorted(rep)) == "[1, 2]"


def test_damaged_files_give_what_parses(spark):
    from millrace.operators import code

    text = "import os\n\n@dec\ndef f(a,\n      b):\n    g()\n\ndef broken(:\n    x = 1\n\nclass C:\n    def m(self):\n        self.m()\n<<<<<<< HEAD\nif a:\n    pass\nelse:\n    h()\n"
    p = code.parse_python(spark.createDataFrame([("r", "d.py", text), ("r", "e.py", "(" * 300), ("r", "f.py", "x = \0"), ("r", "deep.py", "x = " + "-" * 100_000 + "1")], "repo string, path string, text string"))
    rows = {r.path: r for r in p.collect()}
    d = rows["d.py"]
    assert d.status == "parse_error" and {(x.fqn, x.start) for x in d.defs} == {("d", 1), ("d.f", 3), ("d.C", 11), ("d.C.m", 12)}
    assert {(x.kind, x.dst, x.line) for x in d.edges} == {("import", "os", 1), ("call", "g", 6), ("call", "self.m", 13), ("call", "h", 18)}
    assert all(rows[x].status == "parse_error" for x in ("e.py", "f.py", "deep.py"))
