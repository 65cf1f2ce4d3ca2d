import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ["PYTHONPATH"] = os.pathsep.join([sys.path[0], os.environ.get("PYTHONPATH", "")])

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from sealwright.session import local_session

    scratch = tempfile.mkdtemp(prefix="spark-")
    session = local_session(4, 4, **{"spark.checkpoint.dir": f"{scratch}/shared", "spark.local.dir": f"{scratch}/local", "spark.sql.warehouse.dir": f"{scratch}/warehouse", "spark.driver.memory": "4g"})
    yield session
    session.stop()


def plain(value):
    if isinstance(value, float):
        return float(f"{value:.9g}")
    if isinstance(value, (list, tuple)):
        return tuple(plain(x) for x in value)
    return value


def same_as_duckdb(spark, query, sql, sf_dir=SMALL):
    """The rows of a query and of its SQL, both sorted, as texts."""
    import duckdb

    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM read_parquet('{sf_dir}/{name}')")
    df = query(spark, sf_dir)
    found = con.execute(sql)
    columns = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(columns)
    order = sorted(columns)
    ours = sorted(repr([plain(r[c]) for c in order]) for r in df.collect())
    theirs = sorted(repr([plain(r[columns.index(c)]) for c in order]) for r in found.fetchall())
    assert ours == theirs
    return ours
