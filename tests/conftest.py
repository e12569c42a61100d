import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
DATA = os.environ.get("MARLSPIKE_TESTDATA", "/root/testdata")


@pytest.fixture(scope="session")
def spark():
    from marlspike.session import session

    own = session("tests", "local[4]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false", spark__driver__memory="4g", spark__ui__showConsoleProgress="false")
    own.sparkContext.setLogLevel("ERROR")
    yield own
    own.stop()


@pytest.fixture(scope="session")
def small():
    path = f"{DATA}/sf0.001"
    if not os.path.isdir(path):
        pytest.skip("no test data")
    return path


@pytest.fixture(scope="session")
def compare():
    """Compares a DataFrame with DuckDB's rows for a SQL text over the tables of a directory."""
    import duckdb

    def rows(columns, found):
        return sorted(repr([None if v != v else float(v) + 0.0 if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) for v in (r[c] for c in columns)]) for r in found)

    def check(df, sql, sf_dir):
        db = duckdb.connect()
        for name in os.listdir(sf_dir):
            if name.endswith(".parquet"):
                db.sql(f"create view {name[:-8]} as select * from '{sf_dir}/{name}'")
        own = db.sql(sql)
        names = sorted(own.columns)
        assert sorted(df.columns) == names
        expected = [dict(zip(own.columns, r, strict=True)) for r in own.fetchall()]
        assert rows(names, [r.asDict() for r in df.collect()]) == rows(names, expected)

    return check
