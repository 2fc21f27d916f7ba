import pytest

from millrace import session


def test_small_files_are_created_once(spark):
    path = session.fresh_path(spark, "claim")
    assert session.claim(spark, path, "one") and not session.claim(spark, path, "two")
    assert session.read_text(spark, path) == "one" and session.exists(spark, path)
    folder, name = path.rsplit("/", 1)
    assert name in session.names_in(spark, folder) and session.names_in(spark, folder + "/none") == []
    session.remove(spark, path)
    assert not session.exists(spark, path)


def test_a_cluster_needs_a_shared_folder(spark):
    class Context:
        master, applicationId = "spark://host:7077", "app"

        def getConf(self):
            return {}

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(Session())
    assert session.shared_dir(spark)


def test_tables_over_their_bound_are_an_error(spark):
    assert len(session.small_rows(spark.range(3), "rows", 3)) == 3
    with pytest.raises(ValueError, match="more than 2"):
        session.small_rows(spark.range(3), "rows", 2)
