"""Every text query over tables without rows, and over tables with null rows, repeated rows and extra columns."""

import pytest
import tables

from spanforge.llm import queries


@pytest.fixture(scope="module", params=["empty", "dirty"])
def folder(request, data, tmp_path_factory):
    return tables.write(data, str(tmp_path_factory.mktemp(request.param)), request.param)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_edges(spark, folder, name):
    rows = queries.QUERIES[name](spark, folder).collect()
    if name.endswith("_found"):
        assert len(rows) == len({tuple(r) for r in rows})
