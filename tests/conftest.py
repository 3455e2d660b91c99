import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from plyspark.session import importable, local_session

    s = local_session(4, 2, "3g", {"spark.checkpoint.dir": tmp_path_factory.mktemp("shared").as_uri()})
    s.sparkContext.setLogLevel("ERROR")
    importable(s)
    return s


@pytest.fixture(scope="session")
def sf():
    return SF


def duck(sf_dir: str):
    import duckdb

    c = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return c


def assert_matches(df, connection, sql: str) -> None:
    """Equal rows, columns by name."""
    columns = sorted(df.columns)
    got = sorted(repr(tuple(r[c] for c in columns)) for r in df.collect())
    connection.execute(sql)
    names = [d[0] for d in connection.description]
    assert sorted(names) == columns
    want = sorted(repr(tuple(float(r[names.index(c)]) if type(r[names.index(c)]).__name__ == "Decimal" else r[names.index(c)] for c in columns)) for r in connection.fetchall())
    assert got == want
