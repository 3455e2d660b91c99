import pytest
from conftest import assert_matches, duck

from plyspark.plans import kernel_queries, queries

QUERIES, ORACLE_SQL = queries.QUERIES | kernel_queries.QUERIES, queries.ORACLE_SQL | kernel_queries.ORACLE_SQL


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_sql(spark, sf, name):
    assert_matches(QUERIES[name](spark, sf), duck(sf), ORACLE_SQL[name])


def test_entry(spark, sf):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(QUERIES) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_the_rest_does_without_the_llm_subpackage(tmp_path):
    """A copy without the subpackage and the pipeline imports, and has the other queries."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "plyspark", tmp_path / "plyspark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=tmp_path, capture_output=True, text=True, check=True, env={"PATH": "/usr/bin"})
    assert done.stdout.split() == [str(len(QUERIES)), str(len(ORACLE_SQL))]
