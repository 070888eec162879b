import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pagewright.session import local_session

    session = local_session(4, 4, "4g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for name in sorted(os.listdir(SF)):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SF}/{name}'")
    return con


def same(spark, duck, query, sql):
    """Rows of a registered query against its SQL, as text, in any order."""
    df = query(spark, SF)
    cols = sorted(df.columns)
    found = duck.execute(sql)
    names = [c[0] for c in found.description]
    assert cols == sorted(names)
    text = lambda v: "~" if v is None else str(v)
    got = sorted(tuple(text(r[c]) for c in cols) for r in df.collect())
    want = sorted(tuple(text(r[names.index(c)]) for c in cols) for r in found.fetchall())
    assert got == want
