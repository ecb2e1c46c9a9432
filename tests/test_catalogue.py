"""Every catalogue query with SQL gives the rows of its SQL."""

import duckdb
import pytest

from fathom.plans import queries as plans

FOLDER = "/root/testdata/sf0.001"
NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for n in NAMES:
        c.execute(f"create view {n} as select * from read_parquet('{FOLDER}/{n}.parquet')")
    return c


def plain(rows):
    show = lambda v: "null" if v is None else repr(round(v, 6)) if isinstance(v, float) else str(v)
    return sorted(tuple(map(show, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_equals_sql(spark, db, name):
    got = plans.queries()[name](spark, FOLDER)
    columns = sorted(got.columns)
    asked = db.execute(plans.oracle_sql()[name])
    found = [d[0] for d in asked.description]
    assert sorted(found) == columns
    at = [found.index(c) for c in columns]
    assert plain(tuple(r) for r in got.select(*columns).collect()) == plain(tuple(r[i] for i in at) for r in asked.fetchall())
