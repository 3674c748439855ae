"""Every registered audit query against its SQL, on the smallest tables."""

import glob

import duckdb
import pytest

from lodemark.plans.audit_queries import ORACLE_SQL, QUERIES

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{D}/*.parquet"):
        con.sql(f"create view {path.split('/')[-1][:-8]} as select * from '{path}'")
    return con


def plain(df):
    names = sorted(df.columns)
    return sorted(tuple("" if str(v) in ("None", "nan", "<NA>") else str(v) for v in row) for row in df[names].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, duck, name):
    got, want = QUERIES[name](spark, D).toPandas(), duck.sql(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


def test_rows_only(spark):
    assert QUERIES["stratified_sample"](spark, D).count() == 24
    recall = {r["k"]: r["recall"] for r in QUERIES["ann_recall"](spark, D).collect()}
    assert sorted(recall) == [1, 3, 5, 10] and all(recall[k] >= least for k, least in ((1, 0.99), (3, 0.93), (5, 0.9), (10, 0.89)))
