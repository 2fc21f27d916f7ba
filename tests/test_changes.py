import pytest

from millrace.operators.changes import ChangeFeed, Overtaken, latest_by, trusted_state
from millrace.session import fresh_path

KEYS = ["repo", "path"]


def listing(spark, rows):
    return spark.createDataFrame(rows, "repo string, path string, file_sha string")


def none(spark):
    return listing(spark, [])


def processed(feed):
    return sorted((r.path, r.file_sha) for r in feed.processed().collect())


def test_trusted_rows(spark):
    runs = spark.createDataFrame([(1, 10, "success"), (2, 20, "failed"), (3, 30, "success"), (4, 40, "aborted")], "run_id int, started_at bigint, status string")
    log = spark.createDataFrame(
        [("r", "a", "S1", 12), ("r", "a", "S2", 25), ("r", "b", "S3", 5), ("r", "c", None, 31), ("r", "c", "S4", 11), ("r", "d", "S5", 39), ("r", "d", "S6", 41), (None, "e", "S7", 30)],
        "repo string, path string, file_sha string, last_indexed_at bigint",
    )
    got = {r.path: r.file_sha for r in trusted_state(log, runs, KEYS, "file_sha", "last_indexed_at").collect()}
    assert got == {"a": "S1", "c": "S4", "d": "S5", "e": "S7"}


@pytest.mark.parametrize("stop", ["plan", "sink"])
def test_replay_neither_skips_nor_repeats(spark, stop):
    feed = ChangeFeed(spark, fresh_path(spark, "t"), KEYS, "file_sha", part_rows=2)
    feed.capture(listing(spark, [("r", "a", "1"), ("r", "b", "2"), (None, "c", "3")]), listing(spark, [("r", "b", "2")]))
    with pytest.raises(RuntimeError):
        feed.run(fail_after=stop)
    feed.capture(listing(spark, [("r", "a", "1"), ("r", "b", "9"), (None, "c", "3")]), none(spark))  # arrives before the replay
    assert feed.run() == 0
    assert processed(feed) == [("a", "1"), ("c", "3")]
    assert feed.run() == 1 and feed.run() is None
    assert processed(feed) == [("a", "1"), ("b", "9"), ("c", "3")]


def test_case_of_fingerprints_and_unchanged(spark):
    feed = ChangeFeed(spark, fresh_path(spark, "t"), KEYS, "file_sha", part_rows=1)
    feed.capture(listing(spark, [("r", "a", "AB"), ("r", "n", None)]), listing(spark, [("r", "a", "ab")]))
    feed.run()
    assert processed(feed) == [("n", None)]
    feed.capture(listing(spark, [("r", "a", "ab"), ("r", "n", None)]), listing(spark, [("r", "a", "ab")]))
    assert feed.run() is None


def test_empty_and_latest(spark):
    feed = ChangeFeed(spark, fresh_path(spark, "t"), KEYS, "file_sha", part_rows=1)
    feed.capture(none(spark), none(spark))
    assert feed.run() is None and feed.processed().count() == 0
    feed.capture(listing(spark, [("r", "a", "1")]), listing(spark, [("r", "a", "1")]))  # nothing has changed
    assert feed.run() is None and feed.processed().select(*KEYS).count() == 0
    t = spark.createDataFrame([("r", "a", "1", 1), ("r", "a", "2", 2), ("r", "a", "0", 2)], "repo string, path string, file_sha string, seen_at bigint")
    assert latest_by(t, KEYS, ["seen_at"], ["file_sha"]).first().file_sha == "2"


def test_of_two_runs_one_stops(spark, monkeypatch):
    folder = fresh_path(spark, "t")
    a, b = (ChangeFeed(spark, folder, KEYS, "file_sha") for _ in range(2))
    a.capture(listing(spark, [("r", "a", "1")]), none(spark))
    stale = {k: b._numbers(k) for k in ("log", "plans", "sink", "commits", "state")}
    assert a.run() == 0
    with monkeypatch.context() as m:
        m.setattr(b, "_numbers", lambda kind: stale[kind])  # listed before the other run published
        with pytest.raises(Overtaken):
            b.run()
        stale["log"] = []
        with pytest.raises(Overtaken):
            b.capture(listing(spark, [("r", "a", "2")]), none(spark))
    assert b.run() is None and processed(b) == [("a", "1")]


def test_compacted_state_is_the_log(spark):
    feed = ChangeFeed(spark, fresh_path(spark, "t"), KEYS, "file_sha", part_rows=1, compact_after=2)
    want = []
    for k in range(5):
        feed.capture(listing(spark, [("r", "a", str(k // 2)), (None, "b", "x")]), none(spark))
        feed.run()
    want = [("a", "0"), ("a", "1"), ("a", "2"), ("b", "x")]
    assert processed(feed) == want and feed._numbers("state") == [1, 3]
