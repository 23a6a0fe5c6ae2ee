import os

import pytest

from foliant.plans.catalogue import ORACLES, QUERIES, flagship

DATA = "/root/testdata/sf0.001"


def norm(rows):
    return sorted(tuple("" if v is None else f"{float(v):.6f}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) for v in r) for r in rows)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    want = con.sql(f"SELECT {', '.join(cols)} FROM ({ORACLES[name]})").fetchall()
    assert norm(df.select(*[f"`{c}`" for c in cols]).collect()) == norm(want)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
def test_entry(spark):
    import __spark_entry__ as e

    assert flagship(spark, DATA).columns == e.entry(spark).columns
    assert set(e.oracle_sql()) <= set(e.queries())
