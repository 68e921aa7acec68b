"""Every query that SQL can express, against DuckDB; the others must run."""

import compare
import pytest

from spanforge.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_matches_sql(spark, data, name):
    compare.compare(spark, data, catalogue.QUERIES[name], catalogue.ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE)))
def test_runs(spark, data, name):
    df = catalogue.QUERIES[name](spark, data)
    rows = df.collect()
    assert rows, "the tables hold rows for every query"
    if name.endswith("_found"):
        assert len(set(rows)) == len(rows)
    assert len(set(df.columns)) == len(df.columns)


def test_every_oracle_has_a_query():
    assert set(catalogue.ORACLE) <= set(catalogue.QUERIES)
    assert catalogue.FLAGSHIP in catalogue.QUERIES
