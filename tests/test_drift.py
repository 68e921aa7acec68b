import json

from spanforge.operators import drift

SCHEMA = "file_name string, producer string, file_seq int, line_no int, body string, path string, n int"


def lines(seq, objs, producer="p"):
    return [(f"f{seq}", producer, seq, i, o if isinstance(o, str) else json.dumps(o), "clash", 1) for i, o in enumerate(objs)]


def changes(spark, rows):
    out = drift.migration_steps(spark.createDataFrame(rows, SCHEMA)).select("file_name", "old_path", "new_path", "change_kind").collect()
    return sorted(tuple(r) for r in out)


def many(k, **fields):
    return [{**fields, "id": i} for i in range(k)]


def test_kinds_of_change(spark):
    rows = lines(1, many(10, a="x", agent={"name": "n"}, gone=1)) + lines(2, many(10, a=[1], agentName="n", come=True))
    assert changes(spark, rows) == [("f2", "", "come", "added"), ("f2", "a", "a", "retyped"), ("f2", "agent.name", "agentName", "renamed"), ("f2", "gone", "", "removed")]


def test_rare_keys_bad_and_repeated_lines(spark):
    first = many(20, a=1)
    second = [{**x} for x in many(20, a=1)]
    second[3]["oops"] = 1
    rows = lines(1, first) + lines(2, [*second, second[3], '{"a": ', "[1]", "null", "", '{"a": NaN}'])
    assert changes(spark, rows) == []


def test_nulls_keep_the_earlier_type(spark):
    rows = lines(1, many(5, a="x")) + lines(2, many(5, a=None)) + lines(3, many(5, a=[1])) + lines(4, many(5, a=[2]))
    assert changes(spark, rows) == [("f3", "a", "a", "retyped")]


def test_file_without_records_is_passed_over(spark):
    rows = lines(1, many(3, a=1)) + lines(2, ["{", "x"]) + lines(3, many(3, a=1, b="y"))
    assert changes(spark, rows) == [("f3", "", "b", "added")]


def test_renames_go_to_the_most_alike(spark):
    assert drift.pair_renames([("trace_id", "string"), ("zeta", "string")], [("traceId", "string")]) == [("trace_id", "traceId")]
    assert drift.pair_renames([("a", "string")], [("a2", "number")]) == []
    assert drift.pair_renames([], []) == []


def test_empty_and_null_keys(spark):
    assert changes(spark, []) == []
    assert changes(spark, [(None, None, None, None, None, None, None), (None, None, None, 1, '{"a":1}', None, None)]) == []


def test_unify_follows_renames_and_casts(spark):
    rows = lines(1, [{"trace_id": "t1", "metrics": {"total_steps": 3}, "k": {"z": 1}}]) + lines(2, [{"traceId": "t2", "metrics": {"total_steps": "4"}, "k": {"z": 1}}, {"traceId": None, "metrics": {"total_steps": [5]}, "k": {"z": 1}}])
    t = drift.unify(spark.createDataFrame(rows, SCHEMA)).orderBy("file_name", "line_no").collect()
    assert [(r.trace_id, r.metrics__total_steps) for r in t] == [("t1", 3.0), ("t2", 4.0), (None, 5.0)]
    assert json.loads(t[0].extra) == {"k.z": 1}


def test_deep_and_long_bodies(spark):
    deep = '{"a":' * 3000 + "[1]" + "}" * 3000
    got = changes(spark, lines(1, [deep, json.dumps({"a": "x" * 1_000_000})]) + lines(2, many(2, a="y")))
    assert got == [("f2", "", "id", "added"), ("f2", "a" + ".a" * 2999, "", "removed")]


def test_regular_fields_have_one_name_and_type(spark):
    rows = lines(1, many(5, agent={"provider": "x"}, b="one")) + lines(2, many(5, agent_provider="y", c="two")) + lines(3, [*many(5, agent_provider=7, c="three"), {"id": 9, "once": [1]}])
    rows += lines(1, many(5, agent_provider="z"), producer="q")
    t = drift.unify(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {(r.producer, r.file_name, r.agent__provider) for r in t} >= {("p", "f1", "x"), ("p", "f2", "y"), ("p", "f3", "7"), ("q", "f1", "z")}
    assert {r.b for r in t if r.file_name == "f2"} == {"two"} and {r.id for r in t} == {0.0, 1.0, 2.0, 3.0, 4.0, 9.0}
    assert all("agent_provider" not in r.extra and "c" not in json.loads(r.extra) for r in t)
    assert [json.loads(r.extra)["once"] for r in t if r.id == 9] == [["1"]]


def test_a_rename_does_not_reach_earlier_files(spark):
    rows = lines(1, many(5, a="a1", other=True)) + lines(2, many(5, a="a2", spare="s2", other=True)) + lines(3, many(5, a="a3", other=True)) + lines(4, many(5, spare="a4", other=True))
    t = drift.unify(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {(r.file_name, r.a, r.spare) for r in t} == {("f1", "a1", None), ("f2", "a2", "s2"), ("f3", "a3", None), ("f4", "a4", None)}


def test_a_free_name_may_come_back(spark):
    """Six files of one producer: ``sid`` is another field at first, then the new name of session_id, then a new number."""
    six = [[{"sid": f"OTHER{i}", "session_id": f"A{i}", "z": True} for i in range(5)], [{"session_id": f"B{i}", "z": True} for i in range(5)], [{"sid": f"C{i}", "z": True} for i in range(5)]]
    six += [[{"sid": f"D{i}", "z": True} for i in range(5)], [{"session_id": f"E{i}", "z": True} for i in range(5)], [{"session_id": f"F{i}", "sid": i, "z": True} for i in range(5)]]
    rows = [r for k, f in enumerate(six) for r in lines(k + 1, f)]
    t = drift.unify(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {(r.file_name, r.session_id) for r in t} == {(f"f{k + 1}", f"{x}{i}") for k, x in enumerate("ABCDEF") for i in range(5)}
    assert {(r.file_name, r.sid) for r in t if r.sid is not None} == {("f6", float(i)) for i in range(5)}  # as many files have a number as a text: number


def test_fields_of_one_name_at_the_same_time():
    got = drift.follow([(2, "a", "b", "renamed"), (3, "", "a", "added"), (5, "b", "", "removed")])
    assert got == [("a", 3, 0, "a__3"), ("b", 2, 5, "a")]
    assert drift.follow([(2, "sid", "session_id", "renamed")]) == [("sid", 1, 2, "session_id")]


def test_rules_name_renames_casts_and_defaults(spark):
    rows = lines(1, many(5, a="x", m=1)) + lines(2, many(5, aa="x", m="2")) + lines(3, many(5, aa="x", m=3))
    got = {(r.file_name, r.rule, r.path, r.name) for r in drift.rules(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {("f2", "cast", "m", "m"), ("f2", "rename", "aa", "a"), ("f3", "rename", "aa", "a")}


def test_repeated_lines_count_once(spark):
    ten = many(10, a="x")
    ten[0]["b"] = 1
    rows = lines(1, many(10, a="x")) + lines(2, [*ten, *[ten[1]] * 30]) + lines(3, many(10, a="x"))
    assert changes(spark, rows) == [("f2", "", "b", "added"), ("f3", "b", "", "removed")]
