import random

from millrace.operators.hierarchy import components, current_links, descendants, hierarchies, outcomes


def brute(links):
    parent, out = dict(links), {}
    for v in parent:
        seen, at = [], v
        while at is not None and at in parent and at not in seen:
            seen.append(at)
            at = parent[at]
        if at is None:
            out[v] = ("root", list(reversed(seen)))
        elif at not in parent:
            out[v] = ("lost_parent", list(reversed(seen)))
        else:
            out[v] = ("cycle" if at == v else "under_cycle", None)
    return out


def rows(spark, links, **kw):
    df = spark.createDataFrame([(a, b) for a, b in links], "id bigint, parent_id bigint")
    return {r.id: r for r in hierarchies(df, **kw).collect()}


def test_against_brute_force_in_both_branches(spark):
    rng = random.Random(3)
    links = [(i, rng.choice([None, 9999, *range(1, 61)])) for i in range(1, 61)]
    links += [(100, 101), (101, 102), (102, 100), (103, 102), (104, 103), (200, 200), (201, 200)]
    want = brute(links)
    for cap in (200_000, 2):  # the second cap sends every component through doubling
        got = rows(spark, links, component_cap=cap)
        assert set(got) == set(want)
        for v, (outcome, path) in want.items():
            assert got[v].outcome == outcome, (v, cap)
            assert (list(got[v].path) if got[v].path is not None else None) == path
            assert got[v].depth == (None if path is None else len(path) - 1)
        assert got[102].is_back_edge and got[100].cycle_id == 100 and got[104].cycle_id == 100
        assert sum(r.is_back_edge for r in got.values() if r.cycle_id in (100, 200)) == 2
        links_df = spark.createDataFrame(links, "id bigint, parent_id bigint")
        kinds = {r.id: (r.outcome, r.cycle_id, r.is_back_edge) for r in outcomes(links_df, component_cap=cap).collect()}
        assert kinds == {v: (got[v].outcome, got[v].cycle_id, got[v].is_back_edge) for v in got}
        below = {v: sum(v in p[:-1] for o, p in want.values() if p) for v in want}
        assert all(got[v].n_descendants == below[v] for v, (o, p) in want.items() if p)


def test_deep_chain_and_descendants(spark):
    n = 700
    df = spark.createDataFrame([(i, i - 1 if i else None) for i in range(n)], "id bigint, parent_id bigint")
    tree = hierarchies(df)
    assert tree.agg({"depth": "max"}).first()[0] == n - 1
    assert descendants(tree).count() == n * (n - 1) // 2
    assert {r.id: r.depth for r in components(df).collect()} == {i: i for i in range(n)}
    bounded = hierarchies(df, element_cap=1000)  # its paths would not fit one task
    assert {r.id: list(r.path) for r in bounded.collect()} == {i: list(range(i + 1)) for i in range(n)}


def test_counting_rows_nulls_ties_and_clashing_columns(spark):
    t = spark.createDataFrame(
        [(1, 5, 1, "x"), (1, 0, 2, "y"), (1, 0, 2, "y"), (2, 1, 1, None), (2, None, 1, None), (None, 1, 1, "z"), (3, None, None, "z")],
        "community_id bigint, parent_id bigint, detected_at bigint, id string",
    )
    links = {r.id: r.parent_id for r in current_links(t, "community_id", "parent_id", "detected_at").collect()}
    assert links == {1: None, 2: 1, 3: None}


def test_empty(spark):
    assert rows(spark, []) == {}
