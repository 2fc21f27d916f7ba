import numpy as np
from pyspark.sql import functions as F

from millrace.llm.neighbours import Params, _best, encode, exact_nearest, fit, from_24_bits, nearest, pack, table_scan, to_24_bits, usable_vectors


def table(spark, x, ns="a"):
    return spark.createDataFrame([(ns, f"k{i:05d}", v.tolist()) for i, v in enumerate(x)], "ns string, key string, vec array<float>")


def clusters(n, dim=16, seed=0):
    rng = np.random.default_rng(seed)
    c = rng.standard_normal((max(1, n // 20), dim))
    return (c[rng.integers(len(c), size=n)] + 0.25 * rng.standard_normal((n, dim))).astype(np.float32)


def recall(spark, x, p):
    rows = table(spark, x)
    truth = {(r.key, r.neighbour) for r in exact_nearest(rows, rows.where("cast(substring(key, 2) as int) % 10 = 0"), p.k).collect()}
    got = {(r.key, r.neighbour) for r in nearest(rows, p).collect()}
    return len(truth & got) / len(truth)


def test_recall_against_brute_force(spark):
    assert recall(spark, clusters(3000), Params()) >= 0.9


def test_full_partitions_are_cut_into_blocks(spark):
    assert recall(spark, clusters(900), Params(block_rows=150, leaf_rows=500)) >= 0.9


def test_two_levels_of_centres(spark):
    assert recall(spark, clusters(3000), Params(leaf_rows=60, flat_leaves=8)) >= 0.85


def test_anisotropic_codes_lower_the_parallel_error():
    x = clusters(2000, 32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ix = fit(x, 2000, Params(threshold=0.6))
    err = {}
    for w in (0.0, ix.weight):
        codes = encode(x, ix.books, np.float32(w))
        recon = np.stack([ix.books[j][codes[:, j]] for j in range(16)], 1).reshape(2000, 32)
        err[w] = float((((x - recon) * x).sum(1) ** 2).mean())
    assert ix.weight > 0 and err[ix.weight] < err[0.0]
    codes = encode(x, ix.books, np.float32(ix.weight))
    recon = np.stack([ix.books[j][codes[:, j]] for j in range(16)], 1).reshape(2000, 32)
    assert np.allclose(table_scan(x[:7], pack(codes), ix.books), recon @ x[:7].T, atol=1e-4)
    looked_up = sum(np.einsum("qd,cd->cq", x[:7].reshape(7, 16, 2)[:, j], ix.books[j])[codes[:, j]] for j in range(16))
    assert np.allclose(table_scan(x[:7], pack(codes), ix.books), looked_up, atol=1e-4)


def test_packing_and_selection():
    rng = np.random.default_rng(1)
    x = rng.uniform(-1, 1, (50, 6))
    assert np.abs(from_24_bits(to_24_bits(x)) / (2**23 - 1) - x).max() < 1e-7
    s = rng.standard_normal((20, 5000)).astype(np.float32)
    assert all(set(a) == set(b) for a, b in zip(_best(s, 30).tolist(), np.argsort(-s, axis=1)[:, :30].tolist()))


def test_equal_vectors_ties_small_and_empty(spark):
    x = np.vstack([np.tile([1.0, 0, 0, 0], (30, 1)), [[0.9, 0.1, 0, 0]], [[0, 0, 1, 0]]]).astype(np.float32)
    got = {}
    for r in nearest(table(spark, x)).collect():
        got.setdefault(r.key, []).append((r.rank, r.neighbour))
    assert len(got) == 32 and all(len(v) == 5 for v in got.values())
    assert [n for _, n in sorted(got["k00029"])] == [f"k0000{i}" for i in range(5)]  # outside the index, first keys of its group
    assert [n for _, n in sorted(got["k00000"])] == [f"k0000{i}" for i in range(1, 6)]
    assert {n for _, n in got["k00030"]} == {f"k0000{i}" for i in range(5)}
    assert nearest(table(spark, x[:1])).count() == 0 and nearest(table(spark, x).limit(0)).count() == 0
    two = table(spark, x[-2:], "a").unionByName(table(spark, x[:1], "b"))
    assert [(r.ns, r.key) for r in nearest(two).orderBy("key").collect()] == [("a", "k00000"), ("a", "k00001")]
    assert nearest(table(spark, np.array([[1, 2, 3], [3, 2, 1]], np.float32))).count() == 2  # an odd dimension


def test_usable_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [("a", "m", [1.0, 2.0], 1), ("a", "m", [3.0, 4.0], 2), ("a", "o", [5.0, 6.0], 9), ("b", "m", [0.0, 0.0], 1), ("c", "m", [nan, 1.0], 1), ("d", "m", [inf, 1.0], 1), ("e", "m", None, 1), ("f", "m", [1.0], 1), (None, "m", [1.0, 1.0], 1), ("g", "m", [1.0, None], 1), ("h", "m", [1.0, 1.0], None)]
    df = spark.createDataFrame(rows, "id string, model string, vector array<float>, created_at bigint").withColumn("key", F.lit("clash"))
    got = {r.key: list(r.vec) for r in usable_vectors(df, "id", "vector", "created_at", "m", 2).collect()}
    assert got == {"a": [3.0, 4.0], "h": [1.0, 1.0]}
