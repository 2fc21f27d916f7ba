import random
import re

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from millrace.llm.leakage import leaked_phrases, near_terms, words_of
from millrace.llm.mixing import mix, split_blocks, token_counts
from millrace.llm.provenance import label_files
from millrace.llm.secrets import RULES, detect, find_secrets, looks_live
from millrace.llm.trigrams import TrigramIndex, required_trigrams


# ---- leaks ----


def test_leaks_against_brute_force(spark):
    rng = random.Random(1)
    vocab = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choices(vocab, k=40))) for i in range(12)] + [(90, "too short"), (91, None), (92, "a " * 30)]
    docs = []
    for d in range(80):
        ws = rng.choices(vocab, k=60)
        it = items[rng.randrange(12)][1].split()
        a, n = rng.randrange(20), rng.choice([15, 19, 20, 25])
        at = rng.randrange(40)
        docs.append((d, " ".join(ws[:at]) + " -- " + ",\n".join(w.upper() for w in it[a : a + n]) + " . " + " ".join(ws[at:])))
    docs += [(200, ""), (201, None), (202, docs[0][1]), (203, "a, A​ " * 40)]

    def grams(t):
        ws = words_of(t or "")
        return {tuple(ws[i : i + 20]) for i in range(len(ws) - 19)}

    want = {(i, d) for i, t in items for d, x in docs if grams(t) & grams(x)}
    ddf, idf = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id int, text string")
    got = {(r.item_id, r.doc_id) for r in leaked_phrases(ddf, idf).collect()}
    assert got == want and any(i == 92 for i, _ in want)
    assert {(r.item_id, r.doc_id) for r in leaked_phrases(ddf, idf, most_items=4).collect()} == want  # more items than one pass takes
    near = {(r.item_id, r.doc_id): r.n_terms for r in near_terms(ddf, idf, least=2).collect()}
    assert near and near == {(r.item_id, r.doc_id): r.n_terms for r in near_terms(ddf, idf, least=2, most_items=4).collect()}
    assert leaked_phrases(ddf.limit(0), idf).count() == 0 and leaked_phrases(ddf, idf.limit(0)).count() == 0
    assert near_terms(ddf, idf, least=2).count() >= 0 and near_terms(ddf.limit(0), idf).count() == 0


def test_words_are_cut_alike():
    from millrace.llm.leakage import Shard

    rng = random.Random(9)
    texts = ["", "İstanbul Straße_9 naïve²x\u200by", "a-b_c  D\n"] + ["".join(chr(rng.choice([rng.randrange(32, 0x250), rng.randrange(0x370, 0x530), rng.randrange(0x4E00, 0x4F00), 0x200B, 95])) for _ in range(80)) for _ in range(60)]
    shard = Shard(texts)
    assert [shard.of(i) for i in range(len(texts))] == [words_of(t) for t in texts]
    want = {}
    for row, t in enumerate(texts):
        for at, w in enumerate(words_of(t)):
            if w in ("b", "c", "straße"):
                want.setdefault(w, {}).setdefault(row, []).append(at)
    assert shard.postings({"b", "c", "straße", "nowhere"}) == want and want["b"][2] == [1] and Shard([]).postings(None) == {}


# ---- secrets ----


def test_trigrams_are_required():
    rng = random.Random(2)
    for p, samples in {r"pass(?:word|wd)\s*=\s*x+": ["PassWord =xx", "passwd=x"], r"a(?:bc|bd)e?[fg]h": ["abcfh", "abdegh"], r"(?:foo){2}bar?": ["foofooba", "foofoobar"], r"x*": ["", "xx"], r"[a-z]{3}": ["abc"]}.items():
        q = required_trigrams(p, re.I)
        for s in samples:
            assert re.search(p, s, re.I) and (not q or any(all(g in s.lower() for g in c) for c in q)), (p, s, q)
    texts = ["".join(rng.choices("pasword=xi\n", k=60)) + rng.choice(["", "password = x"]) for _ in range(300)]
    q = required_trigrams(r"pass(?:word|wd)\s*=\s*x+", re.I)
    rows = TrigramIndex(texts, {g for c in q for g in c}).rows(q)
    assert {i for i, t in enumerate(texts) if re.search(r"pass(?:word|wd)\s*=\s*x+", t)} <= rows
    assert all(required_trigrams(p, re.I) for p in RULES.values())


def places(text, settings=False):
    return [(ln, r) for ln, r, _ in find_secrets(text, settings)]


def test_secret_places():
    key = "-----BEGIN RSA PRIVATE KEY-----\nMIIabc123+/=XYZ\nQQQQQQQQQQ\n-----END RSA PRIVATE KEY-----"
    assert places(f'k = """{key}"""\nx = 1') == [(1, "private_key")]
    assert places('db_password = "Hk29fmQ0zz81"') == [(1, "quoted")]
    assert places('url = "postgres://u:Hk29fmQ0@h/db"\nb = "postgres://u:${PW}@h/db"\nc = "postgres://u:%s@h"') == [(1, "url")]
    assert places("API_KEY=a8f5f167f44f4964e6c998dee827110c", True) == [(1, "plain")]
    assert places("API_KEY=a8f5f167f44f4964e6c998dee827110c", False) == []
    assert places('h = {"Authorization": "Bearer Zk29fmQ0zz81AA"}')[0][0] == 1
    assert places("# temporary token KJ2ICZCSHO7LDLUNUKXM until later") == [(1, "prose")]
    for no in ('password = "<password>"', 'password = "changeme"', 'token = os.environ["TOKEN"]', 'secret = "****"', 'token = "ordered-channel"', 'api_key = "${KEY}"', 'sha = "a8f5f167f44f4964e6c998dee827110c"', 'token = shared_probe[6]', "-----BEGIN PUBLIC KEY-----", 'token = "took 12 ms, token was open"', 'dsn = "postgres://u:<password>@h"'):
        assert places(no) == [], no
    assert looks_live("Record-292stale") and not looks_live("pending-header") and not looks_live("")


def test_redaction_keeps_everything_else(spark):
    text = 'a = 1\npassword = "Hk29fmQ0zz81" + "Tail99xZ"\n' + "é" * 5 + "\n"
    rows = [("c1", "a.py", text), ("c1", "a.py", text), ("c2", None, None), ("c3", "b.py", ""), (None, "b.py", text), ("c4", "e.env", "TOKEN=Hk29fmQ0zz81\n" * 2), ("c5", "x.py", "y" * 200_000)]
    df = spark.createDataFrame(rows, "chunk_id string, path string, text string").withColumn("rules", F.lit("clash"))
    found, masked = detect(df)
    assert sorted((r.chunk_id, r.line_no) for r in found.collect()) == [("c1", 2), ("c4", 1), ("c4", 2)]
    m = {r.chunk_id: r.text for r in masked.collect()}
    assert m["c1"] == text.replace("Hk29fmQ0zz81", "*" * 12).replace("Tail99xZ", "*" * 8)
    assert detect(df.limit(0))[0].count() == 0


# ---- origins ----


def test_origins(spark):
    up = "\n".join(f"def fn_{i}(a, b):\n    return alpha_{i} + beta_{i} * gamma_{i}" for i in range(8))
    hand = "def run(x):\n    # the vendored copy is made elsewhere\n    note = 'Code generated by x. DO NOT EDIT.'\n    return work(x)\n"
    mini = "".join(f"var a{i}=b[{i}]||c.d;function e{i}(f,g){{return f.h(g)+{i}}}" for i in range(40))
    rows = [
        ("acme", "src/a.py", hand), ("acme", "src/a.py", hand), ("acme", "third/lib.py", up), ("acme", "gen/x.py", "# Code generated by t. DO NOT EDIT.\nx = 1\n"),
        ("acme", "web/m.js", mini), ("acme", "src/data.py", "D = [\n" + "  1, 2, 3, 4, 5, 6, 7, 8,\n" * 60 + "]\n"), ("acme", "src/own.py", "# Copyright (c) the acme authors\n" + hand),
        ("acme", "lib/o.py", "# Part of zlibx 1.2.3; upstream home: zlibx.example\n" + hand), ("acme", "conf/s.json", '{"a": [' + "1, " * 300 + "1]}"), (None, "q.py", None), ("acme", None, hand), ("a/b", "p.py", hand),
    ]
    df = spark.createDataFrame(rows, "repo string, path string, text string").withColumn("node", F.lit("clash"))
    upstream = spark.createDataFrame([(1, up), (2, None)], "upstream_id int, text string")
    got = {(r.repo, r.path): r.label for r in label_files(df, upstream).collect()}
    assert got == {("acme", "src/a.py"): "handwritten", ("acme", "third/lib.py"): "vendored", ("acme", "gen/x.py"): "generated", ("acme", "web/m.js"): "minified", ("acme", "src/data.py"): "blob", ("acme", "src/own.py"): "handwritten", ("acme", "lib/o.py"): "vendored", ("acme", "conf/s.json"): "handwritten", (None, "q.py"): "handwritten", ("a/b", "p.py"): "handwritten"}
    assert label_files(df.limit(0), upstream).count() == 0
    assert label_files(df, upstream.limit(0)).where("label = 'vendored'").count() == 1


def test_neighbours_decide_files_without_signs(spark, monkeypatch):
    from millrace.llm import provenance

    hand = "def run_{0}(x, y):\n    if x:\n        return work_{0}(y)\n    for z in y:\n        emit(z)\n"
    rows = [("acme", f"src/m{i}.py", hand.format("abcdef"[i])) for i in range(6)] + [("acme", "src/copied.py", "# Part of zlibx 1.2.3; upstream home: zlibx.example\n" + hand.format("q"))]
    rows += [("acme", f"dep/zlibx/f{i}.py", "# Part of zlibx 1.2.3; upstream home: zlibx.example\n" + hand.format("ghijk"[i])) for i in range(5)] + [("acme", "dep/zlibx/bare.py", hand.format("m"))]
    rows += [("acme", f"vendor/own{i}.py", hand.format("rstuv"[i])) for i in range(5)] + [("acme", "vendor/made.py", "# Code generated by t. DO NOT EDIT.\nx = 1\n")]
    df = spark.createDataFrame(rows, "repo string, path string, text string")
    none = spark.createDataFrame([], "upstream_id int, text string")
    get = lambda: {r.path: r.label for r in label_files(df, none).collect()}
    got = get()
    assert got["dep/zlibx/bare.py"] == "vendored" and got["src/copied.py"] == "vendored" and got["vendor/made.py"] == "generated"
    assert all(got[p] == "handwritten" for _, p, _ in rows if p.startswith(("src/m", "vendor/own")))
    monkeypatch.setattr(provenance, "propagate", lambda files: files)
    assert get()["dep/zlibx/bare.py"] == "handwritten"


def test_propagation_equals_enumeration(spark):
    import itertools

    from millrace.llm.provenance import LIKE, propagate

    rng = np.random.default_rng(0)
    nodes = [("r/a/x", "r/a"), ("r/a/y", "r/a"), ("r/b/c/z", "r/b/c"), ("r/w", "r")]
    pot = rng.normal(size=(4, 5))
    df = spark.createDataFrame([(n, p, *map(float, v)) for (n, p), v in zip(nodes, pot)], "node string, parent string, b0 double, b1 double, b2 double, b3 double, b4 double")
    got = {r.node: np.array([r[f"b{i}"] for i in range(5)]) for r in propagate(df).collect()}
    links = [(0, 4), (1, 4), (2, 6), (6, 5), (5, 7), (4, 7), (3, 7)]  # 4 r/a, 5 r/b, 6 r/b/c, 7 r
    marg = np.zeros((4, 5))
    dirs = list(itertools.product(range(5), repeat=4))
    for files in itertools.product(range(5), repeat=4):
        base = sum(pot[i, s] for i, s in enumerate(files))
        tot = sum(np.exp(base + LIKE * sum((files + ds)[a] == (files + ds)[b] for a, b in links)) for ds in dirs)
        for i, s in enumerate(files):
            marg[i, s] += tot
    for i, (n, _) in enumerate(nodes):
        p = np.exp(got[n] - got[n].max())
        assert np.allclose(p / p.sum(), marg[i] / marg[i].sum(), atol=1e-6)


# ---- mixing ----


def test_splitting_tree_is_exact():
    dealt = split_blocks({"a": 1000, "b": 10, "c": 0}, 7, 3)
    for s, n in (("a", 1000), ("b", 10)):
        runs = sorted(by[s] for by in dealt.values() if s in by)
        assert runs[0][0] == 0 and runs[-1][1] == n and all(x[1] == y[0] for x, y in zip(runs, runs[1:]))
    sizes = [sum(z - a for a, z in by.values()) for by in dealt.values()]
    assert max(sizes) - min(sizes) <= 3 and split_blocks({"a": 50}, 4, 1) == split_blocks({"a": 50}, 4, 1)


def test_order_by_ranges_is_the_order(spark):
    from millrace.llm.mixing import _in_order

    rng = random.Random(2)
    rows = [(rng.choice("ab"), i, rng.randrange(1, 9), rng.getrandbits(64) - 2**63 if i % 5 else 7) for i in range(300)]
    df = spark.createDataFrame(rows, "source string, block bigint, n bigint, h bigint")
    got = {(r.source, r.block): (r.rank, r.upto) for r in _in_order(df, ["block"], "n", 300, per_task=20).collect()}
    want = {}
    for s in "ab":
        upto = 0
        for k, (_, b, n, _) in enumerate(sorted((r for r in rows if r[0] == s), key=lambda r: (r[3], r[1]))):
            upto += n
            want[s, b] = (k, upto)
    assert got == want


def test_mix(spark):
    rows = [(i, "Big", 10) for i in range(900)] + [(1000 + i, " small ", 10) for i in range(100)] + [(5000, None, 10), (5001, "other", 10), (None, "big", 10), (5002, "small", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, n_tokens bigint").withColumn("shard", F.lit(0))
    goals = spark.createDataFrame([("big", 0.5, 1), ("small", 0.4, 3), ("absent", 0.1, 2)], "source string, target_share double, max_repeats int")
    rec, rep = mix(docs, goals, shards=5, block_tokens=100)
    r = {x.source: x for x in rep.collect()}
    assert r["absent"].n_tokens == 0 and r["other"].target_share == 0 and r["small"].most_repeats <= 3 and r["big"].most_repeats == 1
    assert abs(r["small"].n_tokens / r["big"].n_tokens - 0.8) < 0.2
    per = rec.groupBy("source", "doc_id").count().groupBy("source").agg(F.max("count").alias("m"), F.min("count").alias("l")).collect()
    assert {x.source: (x.m, x.m - x.l <= 1) for x in per} == {"big": (1, True), "small": (r["small"].most_repeats, True)}
    shards = rec.groupBy("shard").agg(F.count("*").alias("n"), F.max("position").alias("p"), F.countDistinct("position").alias("d")).collect()
    assert len(shards) == 5 and all(x.n == x.p == x.d for x in shards)
    assert mix(docs.limit(0), goals)[0].count() == 0 and mix(docs.limit(0), goals)[1].count() == 3
    assert mix(docs, goals.limit(0))[0].count() == 0


def test_token_counts(spark):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    texts = ["hello world", "", None, "Grüße, señor <|endoftext|> 123"]
    df = spark.createDataFrame(pd.DataFrame({"text": pd.Series(texts, dtype="object")}), "text string")
    got = {r.text: r.n_tokens for r in token_counts(df, "text", str(P.path("byte_bpe_50k.tiktoken")), P.PATTERN).collect()}
    t = Tokenizer.from_file(str(P.path("byte_bpe_50k.json")))
    t.encode_special_tokens = True
    assert got == {x: 0 if x is None else len(t.encode(x, add_special_tokens=False).ids) for x in texts}
