"""Every registered core query runs, and equals its SQL where it has one."""

from __future__ import annotations

import pytest

from tests.compare import connect, same
from tracewright.plans import general, loganalysis

QUERIES = general.QUERIES | loganalysis.QUERIES
SQL = general.SQL | loganalysis.SQL


@pytest.fixture(scope="module")
def duck(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, data, duck):
    df = QUERIES[name](spark, data)
    if name in SQL:
        same(df, duck, SQL[name])
    else:
        assert df.count() >= 0 and df.columns


def test_sql_names_are_queries():
    assert set(SQL) <= set(QUERIES)


def test_entry_point(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns


def test_no_record_with_an_instant_is_out_of_every_range(spark, data):
    from tracewright.operators import filters
    from tracewright.operators.filters import QueryFilter, TimeRange
    from tracewright.plans import base
    from tracewright.plans.tables import table

    timed = base.records(spark, data)
    wanted = {r[0] for r in timed.where("t_us is not null").select("RecordID").collect()}
    df = base.logs(spark, data).distinct()
    got = filters.run(df, QueryFilter(time_range=TimeRange("1990-01-01T00:00:00Z", "2090-01-01T00:00:00+00:00")), zones=table(spark, data, "host_zones"))
    assert got.columns == df.columns and {r[0] for r in got.select("RecordID").collect()} == wanted and len(wanted) > 400
    assert filters.run(df, QueryFilter(), zones=table(spark, data, "host_zones")).count() == df.count()
    with pytest.raises(ValueError):
        filters.predicate(QueryFilter(time_range=TimeRange("1990-01-01T00:00:00Z", "2090-01-01T00:00:00Z")), df.columns)
