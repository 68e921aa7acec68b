import compare
import pytest

from spanforge.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_matches_sql(spark, data, name):
    compare.compare(spark, data, queries.QUERIES[name], queries.ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE)))
def test_runs(spark, data, name):
    rows = queries.QUERIES[name](spark, data).collect()
    assert len(rows) == len({repr(r) for r in rows})


def test_columns(spark, data):
    want = {"p3_found": ["row_id", "field", "path"], "p5_found": ["row_a", "row_b"], "p6_found": ["row_id", "field", "path", "pii_kind"], "p7_found": ["doc_id", "item_id"], "p9_found": ["doc_id", "kind"]}
    assert {n: queries.QUERIES[n](spark, data).columns for n in want} == want
