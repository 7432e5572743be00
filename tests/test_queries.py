"""Every query with SQL agrees with DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from pathloom.functions import fuzzy
from pathloom.plans import queries as plans

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def shown(value):
    if value is None or value != value:
        return "-"
    if isinstance(value, float):
        return f"{value:.6f}"
    return f"{float(value):.6f}" if isinstance(value, int) and not isinstance(value, bool) else str(value)


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_agrees_with_sql(spark, duck, name):
    ours = plans.QUERIES[name](spark, SF)
    columns = sorted(ours.columns)
    theirs = duck.execute(plans.ORACLE_SQL[name])
    names = [d[0] for d in theirs.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    want = sorted(tuple(shown(row[i]) for i in at) for row in theirs.fetchall())
    assert sorted(tuple(shown(v) for v in row) for row in ours.select(columns).collect()) == want


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLE_SQL)))
def test_runs(spark, name):
    assert plans.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_fuzzy_query_equals_all_pairs(spark):
    terms, titles = plans.family_names(spark, SF)
    names = sorted(((r["ord"], r["title"]) for r in titles.collect()))
    want = {}
    for (term,) in terms.collect():
        best, at = max((fuzzy.weighted_ratio(term, t), -i) for i, t in names)
        want[term] = ({i: t for i, t in names}[-at], best) if best >= 0.5 else (None, None)
    assert {r[0]: (r[1], r[2]) for r in plans.QUERIES["fuzzy_best_match"](spark, SF).collect()} == want
    report = fuzzy.bound_report(terms, titles, 0.5).first()
    assert report["compared"] < 0.8 * report["terms"] * report["titles"]
