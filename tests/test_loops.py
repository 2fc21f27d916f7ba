from millrace.operators.hierarchy import descendants, hierarchies, loop_hierarchies


def test_subtrees_of_loops_have_paths_and_descendants(spark):
    links = [(1, None), (2, 1), (100, 101), (101, 102), (102, 100), (103, 102), (104, 103), (200, 200), (201, 200)]
    df = spark.createDataFrame(links, "id bigint, parent_id bigint")
    for cap in (200_000, 2):
        tree = loop_hierarchies(hierarchies(df, component_cap=cap), component_cap=cap)
        got = {r.id: (r.path, r.depth, r.n_descendants, r.outcome, r.root_id) for r in tree.collect()}
        # 102 has the back edge to 100
        assert got == {
            102: ([102], 0, 4, "cycle", None), 101: ([102, 101], 1, 1, "cycle", None), 100: ([102, 101, 100], 2, 0, "cycle", None),
            103: ([102, 103], 1, 1, "under_cycle", None), 104: ([102, 103, 104], 2, 0, "under_cycle", None),
            200: ([200], 0, 1, "cycle", None), 201: ([200, 201], 1, 0, "under_cycle", None),
        }
    pairs = {tuple(r) for r in descendants(tree).collect()}
    assert pairs == {(102, 101, 1), (102, 100, 2), (101, 100, 1), (102, 103, 1), (102, 104, 2), (103, 104, 1), (200, 201, 1)}
