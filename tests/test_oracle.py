"""Every registered query against its SQL; those without one must return rows."""

import pytest

import __spark_entry__ as entry
import compare

QUERIES, ORACLE = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    return compare.connect(sf_dir)


def test_every_sql_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, sf_dir, duck, name):
    ours = compare.spark_table(QUERIES[name](spark, sf_dir))
    assert compare.difference(ours, compare.duck_table(duck, ORACLE[name])) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_returns_rows(spark, sf_dir, name):
    rows = QUERIES[name](spark, sf_dir).collect()
    assert rows
    if "anomaly_score" in rows[0].asDict():
        assert all(0 <= r["anomaly_score"] <= 1 and r["is_anomaly"] in (0, 1) for r in rows)


def test_entry(spark):
    assert 0 < entry.entry(spark).count() <= 20
