import random

import pytest

from millrace.operators import leiden


@pytest.fixture(scope="module")
def graph(spark):
    rng, rows = random.Random(4), []
    for repo, n, groups in (("r", 40, 5), (None, 24, 3), ("s", 6, 2)):
        pairs = set()
        for _ in range(5 * n):
            a, b = rng.randrange(n), rng.randrange(n)
            if a != b and (a % groups == b % groups or rng.random() < 0.06):
                pairs.add((min(a, b), max(a, b)))
        rows += [(repo, f"v{a:02d}", f"v{b:02d}", rng.randint(1, 5)) for a, b in sorted(pairs)]
    return spark.createDataFrame([*rows, ("lone", "x", "y", 1)], "repo string, a string, b string, weight long")


def rows_of(levels):
    return {(r.repo, r.level, r.fqn): r.cluster for r in levels.collect()}


def test_joins_and_tasks_give_the_same(graph):
    tasks = rows_of(leiden.communities(graph))
    assert tasks == rows_of(leiden.communities(graph, cap=0)) == rows_of(leiden.communities(graph, cap=60))
    assert {k[0] for k in tasks} == {"r", None, "s", "lone"}


def test_communities_are_the_planted_ones():
    rng, n, groups = random.Random(7), 60, 6
    pairs = [(a, b, 1.0) for a in range(n) for b in range(a + 1, n) if rng.random() < (0.7 if a % groups == b % groups else 0.03)]
    zero = leiden.hierarchy_of([f"v{i:02d}" for i in range(n)], pairs)[0]
    assert all(len({zero[v] for v in range(g, n, groups)}) == 1 for g in range(groups)) and len(set(zero)) == groups


def test_levels_nest_and_parts_hang_together(graph):
    got = rows_of(leiden.communities(graph))
    edges = {}
    for r in graph.collect():
        edges.setdefault(r.repo, []).append((r.a, r.b))
    for repo, es in edges.items():
        for level in range(3):
            of = {v: c for (p, n, v), c in got.items() if p == repo and n == level}
            up = {v: c for (p, n, v), c in got.items() if p == repo and n == level + 1}
            assert not of or set(of) == {v for e in es for v in e} and all(min(v for v in of if of[v] == c) == c for c in of.values())
            assert not up or all(up[v] == up[of[v]] for v in of)
            for c in set(of.values()):
                reached, todo = {c}, [c]
                while todo:
                    v = todo.pop()
                    new = {b if a == v else a for a, b in es if v in (a, b)} & {x for x in of if of[x] == c} - reached
                    reached |= new
                    todo += new
                assert reached == {x for x in of if of[x] == c}
