from spanforge.operators import flatten


def call(i):
    return {"tool_call_id": i, "tool_name": "Bash", "input": "{}", "duration_ms": 1}


def obs(i):
    return {"source_call_id": i, "content": "x"}


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_links(make_traces):
    rec = {
        "row_id": 1,
        "steps": [
            {"step_index": 1, "tool_calls": [call("a"), call(""), call("a"), None], "observations": [obs("a"), obs(""), obs(None), obs("zz"), None]},
            None,
            {"step_index": 1, "parent_step": 1, "tool_calls": None, "observations": [obs("a")]},
        ],
        "attribution": {"files": [{"path": "f", "conversations": [{"url": "x://t/step_1", "ranges": [{"start_line": 1}, None]}, {"url": "x://t/step_9", "ranges": [{"start_line": 2}]}, {"url": None, "ranges": [{"start_line": 3}]}]}, {"path": "g", "conversations": None}, None]},
    }
    got = rows(flatten.child_links(make_traces([rec])))
    assert got == sorted(
        [(1, "call", f"0.{j}", "0") for j in range(3)]
        + [(1, "observation", "0.0", "0.0"), (1, "observation", "0.1", ""), (1, "observation", "0.2", ""), (1, "observation", "0.3", ""), (1, "observation", "2.0", "")]
        + [(1, "range", "0.0.0", "0"), (1, "range", "0.1.0", ""), (1, "range", "0.2.0", "")]
    )
    assert flatten.calls_table(make_traces([rec])).count() == 3
    assert flatten.observations_table(make_traces([rec])).count() == 5
    assert flatten.ranges_table(make_traces([rec])).count() == 3
    assert [(r.step_pos, r.parent_path) for r in flatten.steps_table(make_traces([rec])).orderBy("step_pos").collect()] == [(0, ""), (2, "0")]


def test_nulls_and_empty(make_traces):
    assert flatten.child_links(make_traces([])).count() == 0
    assert flatten.child_links(make_traces([{"row_id": 1}, {"row_id": 2, "steps": [], "attribution": {"files": []}}, {}])).count() == 0


def test_repeated_records_keep_their_rows(make_traces):
    rec = {"row_id": 5, "steps": [{"step_index": 0, "tool_calls": [call("a")]}]}
    assert flatten.child_links(make_traces([rec, {**rec, "row_id": 6}])).count() == 2


def test_huge_number_in_url(make_traces):
    rec = {"row_id": 1, "steps": [{"step_index": 1}], "attribution": {"files": [{"conversations": [{"url": "step_99999999999999999999999", "ranges": [{"start_line": 1}]}]}]}}
    assert rows(flatten.child_links(make_traces([rec]))) == [(1, "range", "0.0.0", "")]
