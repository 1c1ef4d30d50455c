"""Every query of the rule engine against its SQL at the smallest scale."""

import math
from pathlib import Path

import duckdb
import pytest

from hawthorn import queries as engine

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        path = Path(DATA, f"{t}.parquet")
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if path.is_dir() else ''}'")
    return c


def norm(v):
    return "NaN" if isinstance(v, float) and math.isnan(v) else f"{v:.9g}" if isinstance(v, float) else f"{type(v).__name__}:{v}"


def same(spark, con, f, sql):
    df = f(spark, DATA)
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    cols = sorted(names)
    want = sorted(tuple(norm(r[names.index(c)]) for c in cols) for r in cur.fetchall())
    assert sorted(tuple(norm(r[c]) for c in cols) for r in df.collect()) == want


@pytest.mark.parametrize("name", sorted(engine.queries()))
def test_query(spark, con, name):
    same(spark, con, engine.queries()[name], engine.oracle_sql()[name])


@pytest.mark.parametrize("keys", [
    [1, 411, 46, 4146, 55, 4155, 145, 41145, 322, 41322, 469, 41469, 325, 41325],  # T-41 and 46 is the name that T- and 4146 is: one covered, one not; one partial, one not
    [-5, -8, -46, -33, -43], [3_000_000_001, 3_000_000_005, None], [65, 65, 69, 69, 75, 75],
], ids=["one name", "below 0", "beyond 32 bits", "twice"])
def test_tank_bounds_of_odd_keys(spark, tmp_path, keys):
    con = duckdb.connect()
    con.execute("CREATE TABLE supplier AS SELECT unnest($1)::BIGINT AS s_suppkey", [keys])
    con.execute(f"COPY supplier TO '{tmp_path}/supplier.parquet' (FORMAT parquet)")
    got = engine.queries()["tank_bounds"](spark, str(tmp_path)).select("rule_id", "description").collect()
    assert sorted(tuple(r) for r in got) == sorted(con.execute(f"SELECT rule_id, description FROM ({engine.oracle_sql()['tank_bounds']})").fetchall())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 25 and set(engine.queries()) <= set(e.queries())
