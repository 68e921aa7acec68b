import re

import pytest
from pyspark.sql import functions as F

from spanforge.operators import profile

SCHEMA = "load_id bigint, feed string, role string, step_ts string, input_tokens bigint, n int, mask string, column_name string"
SPECS = "path string, column_name string, value_type string, value_pattern string, mask string"
CHECKS = "check_id bigint, load_id bigint, path string, population_rate double, reported_at timestamp_ntz, column_name string"


def specs(spark, rows=None):
    rows = rows if rows is not None else [("p.role", "role", "string", "user|agent", "x"), ("p.in", "input_tokens", "number", None, "x"), ("p.gone", "not_there", "string", "a", "x"), ("p.none", None, None, None, None)]
    return spark.createDataFrame(rows, SPECS)


def load(k, feed, roles, tokens):
    return [(k, feed, r, None, t, 1, "x", "y") for r, t in zip(roles, tokens, strict=True)]


def found(spark, rows, checks=(), sp=None):
    out = profile.issues(spark.createDataFrame(rows, SCHEMA), specs(spark, sp), spark.createDataFrame(list(checks), CHECKS))
    got = [tuple(r) for r in out.collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_issues_of_loads(spark):
    a = load(1, "f", ["user"] * 10 + ["agent"] * 10, [100] * 20)
    b = load(2, "f", ["user"] * 16 + [None, "N/A", " - ", ""], [400] * 20)
    got = found(spark, a + b)
    assert got == {(2, "role", "missing"), (2, "role", "mix"), (2, "input_tokens", "range")}


def test_pattern_also_in_first_load(spark):
    assert found(spark, load(1, "f", ["user"] * 9 + ["USER"], [1] * 10)) == {(1, "role", "pattern")}


def test_latest_report_counts(spark):
    import datetime as dt

    rows = load(1, "f", ["user"] * 9 + [None], [1] * 10)
    t = lambda h: dt.datetime(2025, 1, 1, h)
    old_wrong = [(1, 1, "p.role", 0.1, t(1), "z"), (2, 1, "p.role", 0.9, t(2), "z")]
    assert found(spark, rows, old_wrong) == set()
    assert found(spark, rows, [*old_wrong, (3, 1, "p.role", 0.5, t(2), "z")]) == {(1, "role", "report")}  # tie: higher check_id
    assert found(spark, rows, [*old_wrong, (3, 1, "p.role", None, t(3), "z")]) == set()
    assert found(spark, rows, [(1, 1, "p.role", 0.5, None, "z"), (2, 1, "p.role", 0.9, t(1), "z")]) == set()


def test_empty_and_null(spark):
    assert found(spark, []) == set()
    assert found(spark, load(1, "f", ["x"], [1]), sp=[]) == set()
    assert found(spark, load(None, None, [None] * 4, [None] * 4)) == set()
    every = load(1, "f", ["user"] * 4, [5] * 4) + load(2, "f", [None] * 4, [-1] * 4)
    assert found(spark, every) == {(2, "role", "missing"), (2, "input_tokens", "missing")}


def test_masks(spark):
    df = spark.createDataFrame([("Ab12-x",), ("0a1b2c3d4e5f",), ("",), (None,), ("2025-01-02T03:04:05Z",), ("9999999999x",), ("word " * 20,)], "v string")
    assert [r[0] for r in df.select(profile.mask(df.v)).collect()] == ["Aa99-a", "h12", "", None, "9999-99-99T99:99:99Z", "9999999999a", "ra " * 1 + "a " * 19]


PATTERNS = ["user|agent|system", "[a-z]+/[a-z0-9-]+", "[A-Z][A-Za-z]+", "[0-9a-f]{16}", "[0-9]{4}-[0-9]{2}T[0-9]{2}Z", ".*", r"\d{1,3}(?:\.\d+)?", "(?:a|b)?[^x]z", r"(\w)\1", "x(?=y).", "[^0-9]*"]
VALUES = ["user", "USER", "ab/c-9", "ab/", "Read", "R", "0a1b2c3d4e5f0a1b", "0a1b2c3d4e5f0a1z", "0A1B2C3D4E5F0A1B", "2025-01T07Z", "2025-01X07Z", "", "12.5", "1234", "bqz", "xz", "aa", "xyz", "xy", "Tz", "é", "a" * 70, "aaaaaaaa", "AAAA1111"]


@pytest.mark.parametrize("pattern", PATTERNS)
def test_a_mask_that_decides_decides_as_the_value_does(spark, pattern):
    df = spark.createDataFrame([(v,) for v in VALUES], "v string").withColumn("m", profile.mask(F.col("v")))
    says = profile.verdict(F.col("m"), pattern)
    rows = df.select("v", says.fits.alias("fits"), says.misfits.alias("misfits")).collect()
    for r in rows:
        want = re.fullmatch(pattern, r.v) is not None
        assert not (r.fits and r.misfits)
        assert not r.fits or want, (pattern, r.v)
        assert not r.misfits or not want, (pattern, r.v)


def test_masks_decide_patterns(spark, monkeypatch):
    """The issue ``pattern`` comes from the masks: with one mask for all values it is lost."""
    sp = [("p.role", "step_ts", "string", "[0-9]{4}-[0-9]{2}", "x")]
    rows = [(1, "f", None, v, 1, 1, "x", "y") for v in ["2025-01"] * 8 + ["01/2025"] * 2]
    assert found(spark, rows, sp=sp) == {(1, "step_ts", "pattern")}
    monkeypatch.setattr(profile, "mask", lambda c: F.when(c.isNotNull(), "9999-99"))
    assert found(spark, rows, sp=sp) == set()


def test_rare_masks_and_divergence(spark):
    sp = [("p.t", "step_ts", "string", None, "x")]
    rows = [(1, "f", None, "a1", 1, 1, "x", "y")] * 10 + [(2, "f", None, v, 1, 1, "x", "y") for v in ["b7"] * 6 + ["B7"] * 4]
    t = spark.createDataFrame(rows, SCHEMA)
    r = {x.load_id: x for x in profile.load_profile(t, specs(spark, sp)).collect()}
    assert (r[1].rare_mask_share, r[1].top_mask) == (0.0, "a9") and abs(r[2].rare_mask_share - 0.4) < 1e-9 and abs(r[2].mask_divergence - 0.4) < 1e-9
    assert {(x.load_id, x.mask, x.is_rare) for x in profile.mask_report(t, specs(spark, sp)).collect()} == {(1, "a9", False), (2, "a9", False), (2, "A9", True)}


def test_divergence_is_half_the_differences(spark):
    rows = load(1, "f", ["user"] * 5 + ["agent"] * 5, [1] * 10) + load(2, "f", ["user"] * 8 + ["zed"] * 2, [1] * 10)
    t = spark.createDataFrame(rows, SCHEMA)
    m = profile.mask_counts(t, profile.read_specs(specs(spark), t))
    d = {(r.load_id, r.column_name): r.distance for r in profile.divergence(m, "value_key").collect()}
    assert abs(d[(2, "role")] - 0.5) < 1e-9


def test_reports_over_whole_profile(spark):
    t = spark.createDataFrame(load(1, "f", ["user", "user"], [1, 3]), SCHEMA)
    r = {x.column_name: x for x in profile.load_profile(t, specs(spark)).collect()}
    assert r["input_tokens"].n_rows == 2 and r["input_tokens"].median_value == 1.0
    assert {(x.column_name, x.n_distinct) for x in profile.load_distincts(t, specs(spark)).collect()} == {("role", 1), ("input_tokens", 2)}
    assert profile.mask_report(t, specs(spark)).count() == 2
