import pytest

from spanforge.llm import mixing

TARGETS = "source string, target_share double, max_repeats int, n int"


@pytest.fixture()
def docs(spark):
    rows = [(i, "alpha beta " * (5 + i % 40), [" Big", "big", "BIG "][i % 3], "x") for i in range(900)]
    rows += [(1000 + i, "gamma delta word " * 20, "small", "x") for i in range(20)] + [(2000, None, "big", "x"), (2001, "", "small", "x"), (2002, "lost", None, "x"), (2003, "no target", "other", "x"), (2004, "long " * 100_000, "huge", "x"), (None, "t", "big", "x")]
    return spark.createDataFrame([*rows, rows[0]], "doc_id bigint, text string, source string, tokens string")


def run(spark, docs, targets, total=None):
    sized = mixing.sized_documents(docs)
    planned = mixing.plan(sized, spark.createDataFrame(targets, TARGETS), total)
    mixed = mixing.mixture(sized, planned)
    return {r.source: r for r in mixing.shares(mixed, planned).collect()}, mixed.collect()


def test_shares_and_repeats(spark, docs):
    s, rows = run(spark, docs, [("big", 0.6, 1, 1), (" SMALL", 0.3, 4, 1), ("nothing", 0.1, 2, 1)])
    assert abs(s["big"].reached_share - 2 / 3) < 0.01 and abs(s["small"].reached_share - 1 / 3) < 0.01
    assert s["nothing"].note == "no documents" and s["nothing"].reached_share == 0
    assert len({r.doc_id for r in rows}) == len(rows)
    assert max(r.repeats for r in rows if r.source == "small") <= 4 and max(r.repeats for r in rows if r.source == "big") == 1
    assert {r.repeats for r in rows if r.source == "small"} <= {3, 4} and s["small"].documents_used == 20
    assert all(r.tokens_used <= r.budget for r in s.values())


def test_total_and_determinism(spark, docs):
    a, rows = run(spark, docs, [("big", 0.5, 1, 1), ("small", 0.5, 9, 1)], 2000)
    b, again = run(spark, docs.repartition(7), [("big", 0.5, 1, 1), ("small", 0.5, 9, 1)], 2000)
    assert {(r.doc_id, r.repeats) for r in rows} == {(r.doc_id, r.repeats) for r in again}
    assert 900 <= a["big"].tokens_used <= 1000


def test_prefix_is_that_of_one_sort(spark, docs):
    sized = mixing.sized_documents(docs)
    planned = mixing.plan(sized, spark.createDataFrame([("big", 1.0, 1, 1)], TARGETS), 3000)
    got = {r.doc_id for r in mixing.mixture(sized, planned).collect()}
    upto, want = 0, set()
    for r in sized.where("source = 'big'").orderBy("key", "doc_id").collect():
        upto += r.n_tokens
        if upto <= 3000:
            want.add(r.doc_id)
    assert got == want


def test_empty_and_nulls(spark, docs):
    empty = docs.limit(0)
    s, rows = run(spark, empty, [("big", 0.5, 1, 1)])
    assert rows == [] and s["big"].tokens_used == 0
    assert run(spark, docs, []) == ({}, [])
    s, rows = run(spark, docs, [(None, 0.5, 1, 1), ("big", None, None, 1), ("small", 0.5, None, 1)])
    assert {r.source for r in rows} == {"small"} and s["big"].note == "no target"


def test_cells_are_of_like_size_for_low_weights(spark, monkeypatch):
    """Short and symbol-ridden texts have low weights and so large keys; their source is still spread over the cells."""
    monkeypatch.setattr(mixing, "CELLS", 64)
    docs = spark.createDataFrame([(i, f"{i}#", "low") for i in range(6400)], "doc_id bigint, text string, source string")
    sized = mixing.sized_documents(docs)
    planned = mixing.plan(sized, spark.createDataFrame([("low", 1.0, 1, 1)], TARGETS), 5000)
    per = mixing.in_cells(sized, planned).groupBy("cell").count().collect()
    assert len(per) == 64 and max(r["count"] for r in per) <= 3 * 100
    upto, want = 0, 0
    for r in sized.orderBy("key", "doc_id").collect():
        upto += r.n_tokens
        want += upto <= 5000
    assert mixing.mixture(sized, planned).count() == want
