"""Text queries against their SQL twins in DuckDB on the smallest tables."""

import duckdb
import pytest

from gatekit.llm.queries import SPARK, SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(rows):
    return sorted(tuple("" if v is None else str(round(v, 6)) if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, duck, name):
    df = SPARK[name](spark, SF)
    cols = sorted(df.columns)
    cur = duck.execute(SQL[name])
    have = [d[0] for d in cur.description]
    assert sorted(have) == cols
    want = [tuple(r[have.index(c)] for c in cols) for r in cur.fetchall()]
    assert plain(map(tuple, df.select(*cols).collect())) == plain(want)


def test_one_query_per_operator():
    numbers = sorted(int(name[2:].split("_")[0]) for name in SPARK)
    assert numbers == list(range(1, 14))
