import hashlib
import hmac
import json
import struct
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from millrace.functions import scalars as S
from millrace.operators import code, evaluate, graph, grounding, leiden, retrieve, tables, text, vector
from millrace.sources.files import read_tree
from millrace.sources.vecs import FvecsSource, IvecsSource
from millrace.streaming import webhooks


def one(spark, expr, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expr(F.col("v")).alias("r")).first().r


def test_scalars(spark):
    assert one(spark, S.tokens, "User.login 30 HTTP/2 a é1x") == ["user", "login", "http", "1x"]
    assert one(spark, S.tokens, None) == []
    assert one(spark, S.module_fqn, "app/auth/__init__.py") == "app.auth" and one(spark, S.module_fqn, "__init__.py") == ""
    assert one(spark, S.language_of, "a/B.TSX") == "typescript" and one(spark, S.language_of, "README.md") is None
    assert one(spark, S.symbol_in, "who calls User.login?") == "User.login"
    assert one(spark, S.symbol_in, "what does parse (x) do") == "parse" and one(spark, S.symbol_in, "hello there") is None
    cites = one(spark, S.valid_citations, "[a.py:1-2] [path=\"b/c.py\":3-4] ['d.py':5-6] [\"e.py':1-2] [a.py:1-2] [f.py:9-3] [g.py:0-1]")
    assert [(c.path, c.lo, c.hi) for c in cites] == [("a.py", 1, 2), ("b/c.py", 3, 4), ("d.py", 5, 6)]
    assert one(spark, S.route_of, '```json\n{"route": "x", "reason": ""}\n```').asDict() == {"route": "hybrid", "confidence": 0.5, "reason": "llm"}
    assert one(spark, S.route_of, "no json") is None
    assert one(spark, lambda c: S.command_after_mention(c, "bot"), "hi @Bot: , why?  ") == "why?" and one(spark, lambda c: S.command_after_mention(c, "bot"), "@bot") is None
    assert one(spark, lambda c: S.truncate_lines(c, 2), "a\nb\nc") == "a\nb\n... (1 more lines)"


def test_suffix_callers_and_route(spark):
    nodes = spark.createDataFrame([("pkg.auth.User.login",), ("pkg.api.User.login",), ("pkg.auth.User",), ("pkg.api.Xuser.login",)], "fqn string")
    asked = spark.createDataFrame([(1, "User.login"), (2, "user.LOGIN"), (3, None), (4, "nothing")], "query_id int, symbol string")
    got = sorted((r.query_id, r.fqn) for r in graph.suffix_lookup(asked, nodes).collect())
    assert got == [(q, f) for q in (1, 2) for f in ("pkg.api.User.login", "pkg.auth.User.login")]
    edges = spark.createDataFrame([("m.f", "pkg.auth.User.login", "call", "m.py", 3, 1, 1)], "src string, dst string, kind string, src_path string, src_line int, weight int, indexed_at bigint")
    q = spark.createDataFrame([(1, "who calls User.login?"), (2, "who calls User.logout?"), (3, "hello")], "query_id int, question string")
    ans = {r.query_id: r for r in retrieve.graph_route(q, nodes, edges).collect()}
    assert ans[1].answer == "- pkg.api.User.login has no recorded callers.\n- pkg.auth.User.login:\n    - m.f at [m.py:3-3]" and ans[1].n_citations == 1
    assert ans[2].answer.startswith("No symbol matching 'User.logout'") and ans[3].n_citations == 0
    with pytest.raises(ValueError):
        graph.neighbours(asked, edges, None, "up")


def test_edges_graph_and_communities(spark):
    schema = "src string, dst string, kind string, src_path string, src_line int, weight int, indexed_at bigint"
    e = spark.createDataFrame([("a", "b", "call", "p", 1, 1, 1), ("a", "b", "call", "q", 1, 1, 2), ("b", "a", "call", "p", 3, 1, 1), ("a", "a", "call", "p", 4, 1, 1), ("a", "<unresolved:x>", "call", "p", 5, 1, 1), ("a", "zz", "call", "p", 6, None, 1)], schema)
    up = {(r.src, r.dst, r.src_line): (r.weight, r.src_path) for r in tables.upsert_edges(e.limit(0), e).collect()}
    assert up["a", "b", 1] == (2, "p")
    n = spark.createDataFrame([("a",), ("b",), ("lonely",), (None,)], "fqn string")
    assert [tuple(r) for r in graph.symmetrise(e, n).collect()] == [("a", "b", 3, 3)]
    assert graph.subgraph_stats(e, n).first().asDict() == {"n_vertices": 2, "n_edges": 1, "n_dropped": 2, "n_collapsed": 2, "n_isolated": 1}
    with pytest.raises(ValueError):
        graph.symmetrise(e, n, ())
    pairs = [(x, y, 10) for t in (("a", "b", "c"), ("d", "e", "f")) for i, x in enumerate(t) for y in t[i + 1 :]] + [("c", "d", 1)]
    g = spark.createDataFrame([("r", *p) for p in pairs], "repo string, a string, b string, weight long")
    levels = leiden.communities(g)
    zero = {r.fqn: r.cluster for r in levels.where("level = 0").collect()}
    assert zero["a"] == zero["b"] == zero["c"] != zero["d"] == zero["e"] == zero["f"]
    big = {r.fqn: r.cluster for r in leiden.communities(g, cap=2).where("level = 0").collect()}
    assert big["a"] == big["c"] != big["f"]
    assert leiden.communities(g.limit(0)).count() == 0


def test_tables(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], "k string, at int, v string")
    new = spark.createDataFrame([("a", 0, "n"), ("c", 1, "p"), ("c", 2, "q")], "k string, at int, v string")
    assert sorted(tuple(r) for r in tables.upsert(old, new, ["k"], "at").collect()) == [("a", 0, "n"), ("b", 1, "y"), ("c", 2, "q")]
    ch = {r.k: r.change for r in tables.change_set(old, new.where("at < 2"), ["k"], "v").collect()}
    assert ch == {"a": "modified", "b": "deleted", "c": "added"}
    v = spark.createDataFrame([([1.0, 2.0],), ([1.0],)], "vector array<double>")
    with pytest.raises(Exception, match="vector of length 1"):
        tables.require_dim(v, "vector", 2).collect()


def test_bm25_and_windows(spark):
    docs = spark.createDataFrame([("c1", "session timeout is configured here"), ("c2", "billing invoice"), ("c3", ""), ("c4", None)], "chunk_id string, text string")
    q = spark.createDataFrame([(1, "how is session timeout configured"), (2, "!!")], "query_id int, question string")
    got = text.bm25(q, docs, "chunk_id", "text").collect()
    assert [(r.query_id, r.doc, r.rank) for r in got] == [(1, "c1", 1)]
    assert text.bm25(q, docs.limit(0), "chunk_id", "text").count() == 0
    long = spark.createDataFrame([(1, "\n".join(map(str, range(170)))), (2, " \n "), (3, None)], "id int, text string")
    w = [(r.start_line, r.end_line) for r in text.line_windows(long, "id", "text").orderBy("start_line").collect()]
    assert w == [(1, 80), (77, 156), (153, 170)]
    with pytest.raises(ValueError):
        text.line_windows(long, "id", "text", 4, 4)


def test_vectors(spark, tmp_path):
    base = vector.synthetic(spark, 1024, 32)
    q = vector.synthetic(spark, 50, 32, seed=2).withColumnRenamed("item", "query_id")
    truth = vector.top_k(q, base, 5, "l2")
    got = vector.hnsw_top_k(q, base, 5, shard_rows=600, metric="l2")
    assert evaluate.recall_at_k(truth, got, 5).agg(F.sum("hits")).first()[0] >= 0.96 * 250
    a, b = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<float>, b array<float>").select(vector.distance(F.col("a"), F.col("b"), "cosine").alias("d"), vector.normalise(F.col("a")).alias("n")).first()
    assert a == 1.0 and b == [0.6, 0.8]
    assert vector.parse_metric("Euclidean") == ("l2", True) and vector.parse_metric("what") == ("cosine", False)
    assert abs(sum(x * x for x in vector.hash_embedding("x", 16)) - 1) < 1e-6
    spark.dataSource.register(FvecsSource)
    spark.dataSource.register(IvecsSource)
    p = str(tmp_path / "x.fvecs")
    base.limit(20).select(F.col("item").alias("position"), "vector").write.format("fvecs").option("path", p).mode("append").save()
    back = spark.read.format("fvecs").option("path", p).option("per_task", "7").load()
    assert back.count() == 20 and sorted(map(tuple, (r.vector for r in back.collect()))) == sorted(map(tuple, (r.vector for r in base.limit(20).collect())))
    assert spark.read.format("fvecs").option("path", p).option("max", "3").load().count() == 3
    (tmp_path / "bad.ivecs").write_bytes(struct.pack("<iii", 2, 1, 2) + struct.pack("<ii", 1, 5))
    with pytest.raises(Exception, match="ragged"):
        spark.read.format("ivecs").option("path", str(tmp_path / "bad.ivecs")).load().collect()
    g = vector.Hnsw(heuristic=False)
    assert g.search([1.0], 3) == []
    g.add("a", [1.0, 0.0])
    g.add("a", [0.0, 1.0])
    assert len(g.x) == 1 and g.search([0.0, 1.0], 1)[0][1] == "a"


def test_fusion_and_rerank(spark):
    mk = lambda items: spark.createDataFrame([(1, x, i + 1) for i, x in enumerate(items)], "query_id int, item string, rank int")
    order = [r.item for r in retrieve.fuse(mk("axb"), mk("bxa")).orderBy("rank").collect()]
    assert order[:2] in (["a", "b"],) and set(order) == set("abx")
    chunks = spark.createDataFrame([("a", "r1", "p", 1, 2, "Login user"), ("b", "r2", "p", 1, 2, "user")], "chunk_id string, repo string, path string, start_line int, end_line int, text string")
    q = spark.createDataFrame([(1, "user LOGIN")], "query_id int, question string")
    got = retrieve.hybrid(q, mk("bax"), mk("ba"), chunks, 5).orderBy("rank").collect()
    assert [(r.item, r.score) for r in got] == [("a", 2.0), ("b", 1.0)]
    only = retrieve.hybrid(q, mk("bax"), mk("ba"), chunks, 1, reranking=False, repo="r1")
    assert only.count() == 0  # the filter comes after the cut
    e = spark.createDataFrame([("a", "b", "call"), ("b", "c", "call")], "src string, dst string, kind string")
    hops = {r.fqn: r.hop for r in retrieve.expand_hops(spark.createDataFrame([(1, "a")], "query_id int, fqn string"), e, 2).collect()}
    assert hops == {"a": 0, "b": 1, "c": 2}


def test_community_chunks_take_in_order(spark):
    members = spark.createDataFrame([(1, "m.f", False), (1, "m.g", False), (2, "m.f", False), (2, "m.h", False), (3, "x.K", True), (3, "x.j", False)], "community_id int, fqn string, is_seed boolean")
    chunks = spark.createDataFrame([("f1", "f", "p", 1, 9), ("g1", "g", "p", 20, 25), ("h1", "h", "p", 30, 31), ("k1", "K", "q", 1, 2), ("j1", "j", "q", 5, 50)], "chunk_id string, symbol string, path string, start_line int, end_line int")
    hits = spark.createDataFrame([(7, 1, 1), (7, 2, 2), (7, 3, 3)], "query_id int, hit_rank int, community_id int")
    got = [(r.hit_rank, r.chunk_id) for r in retrieve.community_chunks(hits, members, chunks, 1).orderBy("place").collect()]
    assert got == [(1, "f1"), (2, "h1"), (3, "k1")]


def test_grounding(spark):
    ans = spark.createDataFrame([(1, "ok [a.py:2-3]"), (2, "bad [a.py:2-99] and [a.py:1-1]"), (3, "none"), (4, None)], "query_id int, answer string")
    got = spark.createDataFrame([(1, "a.py", 1, 5), (2, "a.py", 1, 5)], "query_id int, path string, start_line int, end_line int")
    v = {r.query_id: r for r in grounding.verify(ans, got).collect()}
    assert v[1].valid and not v[2].valid and v[3].valid and v[4].valid and len(v[2].kept) == 1
    second = spark.createDataFrame([(2, "still [b.py:1-2]")], "query_id int, answer string")
    done = {r.query_id: r for r in grounding.settle(ans, second, got).collect()}
    assert done[2].answer == "still [citation removed]" and done[2].retried and done[1].answer == "ok [a.py:2-3]" and done[4].answer is None


def test_evaluation(spark):
    v = spark.createDataFrame([("x", float(i)) for i in range(1, 11)] + [("y", 1.0), ("y", 1.0), ("z", None)], "g string, v double")
    got = {r.g: r.at_rank for r in evaluate.percentile_row(v, "g", "v", evaluate.half_even_rank(0.95)).collect()}
    assert got == {"x": 10.0, "y": 1.0}
    assert {r.g: r.at_rank for r in evaluate.percentile_row(v, "g", "v", evaluate.ceil_rank(0.5)).collect()} == {"x": 5.0, "y": 1.0}
    p = spark.createDataFrame([("i", 0.9, 10.0), ("i", 0.8, 20.0), ("i", 0.8, 15.0), ("i", 0.9, 10.0), ("i", 0.7, 20.0)], "g string, x double, y double")
    assert sorted((r.x, r.y) for r in evaluate.pareto(p, "g", "x", "y").collect()) == [(0.8, 20.0), (0.9, 10.0), (0.9, 10.0)]
    e = spark.createDataFrame([(1, "p", 10, 20), (1, "p", 50, 60)], "query_id int, path string, lo int, hi int")
    a = spark.createDataFrame([(1, "p", 25, 30)], "query_id int, path string, lo int, hi int")
    assert evaluate.overlap_recall(e, a).first().recall == 0.5


SOURCE = '''import os.path
from app.db import open_connection as oc


class Base:
    pass


@deco(call_in_decorator())
class User(Base, metaclass=M):
    def login(self):
        self.check()
        self.missing()
        oc().execute()
        os.path.exists("x")

    def check(self):
        return helper(other.thing())


def helper(x=default()):
    def inner():
        return x
    return inner
'''


def test_code(spark):
    files = spark.createDataFrame([("r", "app/__init__.py", ""), ("r", "app/users.py", SOURCE), ("r", "bad.py", "def ("), ("r", "x.ts", "a"), ("r", "README.md", "b"), ("r", "n.py", None)], "repo string, path string, text string")
    p = code.parse_python(files)
    assert {r.path: r.status for r in p.collect()} == {"app/__init__.py": "ok", "app/users.py": "ok", "bad.py": "parse_error", "x.ts": "unsupported", "n.py": "ok"}
    kinds = {r.fqn: (r.kind, r.start_line) for r in code.nodes_of(p).collect()}
    assert kinds["app.users.User"] == ("class", 9) and kinds["app.users.helper.inner"][0] == "method" and kinds["app"] == ("module", 1)
    e = {(r.kind, r.src, r.dst) for r in code.resolve(p).collect()}
    assert ("call", "app.users.User.login", "app.users.User.check") in e
    assert ("call", "app.users.User.login", "<unresolved:self.missing>") in e
    assert ("call", "app.users.User.login", "app.db.open_connection") in e
    assert ("call", "app.users.User.login", "os.path.path.exists") in e
    assert ("inherit", "app.users.User", "app.users.Base") in e and ("def", "app", "app.users") in e and ("import", "app.users", "os.path") in e
    assert not any("call_in_decorator" in d or "default" in d for _, _, d in e)
    c = {(r.parent_symbol, r.symbol): (r.start_line, r.end_line) for r in code.chunks_of(p).collect()}
    assert c[None, "User"] == (9, 10) and c["User", "login"] == (11, 15) and (None, "helper") in c


def test_source_tree(spark, tmp_path):
    for p, t in {"a/__init__.py": "", ".hidden.py": "x", ".git/y.py": "x", "node_modules/z.py": "x", "b.go": "package b"}.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(t)
    rows = {r.path: r for r in read_tree(spark, str(tmp_path)).collect()}
    assert set(rows) == {"a/__init__.py", ".hidden.py", "b.go"}
    assert rows["b.go"].file_sha == hashlib.sha1(b"package b").hexdigest() and rows["b.go"].language == "go"


def test_webhooks(spark, tmp_path):
    def body(**kw):
        return json.dumps(kw)

    mention = body(action="created", comment={"body": "@bot why?", "user": {"login": "x"}}, repository={"full_name": "o/r"})
    rows = [("1", "issue_comment", mention), ("2", "push", body(after="abc", repository={"full_name": "o/r"})), ("3", "push", body(after="0" * 40)), ("4", "issue_comment", "{bad"), ("5", "star", "{}"), ("6", "issue_comment", body(action="created", comment={"body": "@bot hi", "user": {"login": "Bot"}}))]
    sig = lambda p: "sha256=" + hmac.new(b"s", p.encode(), hashlib.sha256).hexdigest()
    df = spark.createDataFrame([(a, b, sig(c), c) for a, b, c in rows], webhooks.EVENT_SCHEMA)
    got = {r.event_id: (r.action, r.detail, r.reason) for r in webhooks.route_events(df, "bot").collect()}
    assert got["1"] == ("answer", "why?", None) and got["2"] == ("reindex", "abc", None) and got["3"][2] == "branch deleted" and got["4"][0] == got["5"][0] == got["6"][0] == "ignore"
    ok = df.select(webhooks.signature_ok("s", F.col("payload"), F.col("signature")).alias("a"), webhooks.signature_ok("", F.col("payload"), F.col("signature")).alias("b")).first()
    assert ok.a and not ok.b
    src, out, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    for k in range(2):  # the same delivery twice
        df.withColumn("received", F.lit(datetime(2024, 1, 1))).write.mode("append").json(src)
        webhooks.start(spark, src, out, cp, "bot", "s").awaitTermination()
    assert spark.read.parquet(out).count() == 6
