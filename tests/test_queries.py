"""Every query of the library gives the rows of its SQL on the smallest tables."""

import os

import duckdb
import pytest

from keylake import plans

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return con


def rows(found, names: list[str]) -> list[tuple]:
    order = sorted(range(len(names)), key=names.__getitem__)
    plain = lambda v: round(v, 9) if isinstance(v, float) else v
    return sorted([tuple(str(plain(r[k])) for k in order) for r in found])


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_rows(spark, db, name):
    got, want = plans.queries()[name](spark, SF), db.sql(plans.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.collect(), got.columns) == rows(want.fetchall(), want.columns)
