import pytest

from millrace.llm.syntax import problems
from millrace.llm.unparsed import check_files


@pytest.mark.parametrize("path, line, head", [("a.py", "x = = 1", ""), ("a.js", "let 1 = 2", ""), ("a.go", "var 1 = 2", "package a")])
def test_every_error_is_stored(path, line, head):
    text = "\n".join([head, *[line] * 2500])
    got = problems(text, path)
    assert sorted({p.line for p in got}) == list(range(2, 2502))


def test_n_errors_counts_all(spark):
    row = check_files(spark.createDataFrame([("r", "a.py", "x = = 1\n" * 1500)], "repo string, path string, text string")).first()
    assert row.n_errors == len(row.errors) == 1500 and row.errors[-1].line == 1500
