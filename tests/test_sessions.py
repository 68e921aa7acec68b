"""Dataset import, sub-agents, snippets and outcomes against hand-written expectations."""

import json

import pytest
from pyspark.sql import functions as F

from spanforge.operators import enrich
from spanforge.sources import datasets, shards, transcripts


def row(i, **more):
    turns = [{"from": "human", "value": "do it"}, {"from": "gpt", "value": f'<think>hm</think><tool_call>{{"name": "patch", "arguments": {{"path": "a.py", "replacement": "x{i}"}}}}</tool_call><tool_call>broken</tool_call>'}, {"from": "tool", "value": '<tool_response>{"content": "done"}</tool_response>'}]
    return {"conversations": turns, "task": f"task {i}", "usage": {"prompt_tokens": 3}, "category": "c", **more}


def test_dataset_import(spark, tmp_path):
    rl = {"conversations": [{"role": "assistant", "content": '<tool_call>{"name": "rl_get_results", "id": "q"}</tool_call>'}, {"role": "tool", "content": '<tool_response>{"tool_call_id": "q", "content": "{\\"reward\\": -1.5}"}</tool_response>'}]}
    rows = [row(0, completed=True, tool_stats={"t": {"count": 4, "failure": 1}}), row(1, completed=False), row(2, partial=True), rl, row(0, completed=True, tool_stats={"t": {"count": 4, "failure": 1}}), {"other": 1}]
    (tmp_path / "d.jsonl").write_text("\n".join(map(json.dumps, rows)) + "\n\n")
    got = {r.session_id: r for r in datasets.load(spark, str(tmp_path), "o/d", model="m1", revision="r" * 20).collect()}
    assert set(got) == {f"o/d:default:{'r' * 12}:{i}" for i in range(5)}
    a, b, c, d = (got[f"o/d:default:{'r' * 12}:{i}"] for i in range(4))
    assert (a.outcome.success, a.outcome.terminal_state) == (True, "goal_reached") and (b.outcome.success, b.outcome.terminal_state) == (False, "abandoned")
    assert (c.outcome.success, c.outcome.terminal_state) == (None, "interrupted") and (d.outcome.success, d.outcome.reward, d.outcome.terminal_state, d.outcome.signal_confidence) == (False, -1.5, "error", "derived")
    call = a.steps[1].tool_calls[0]
    assert (call.tool_name, json.loads(call.input)) == ("Edit", {"file_path": "a.py", "new_string": "x0"}) and a.steps[1].model == "m1" and a.steps[0].model is None
    meta = json.loads(a.metadata)
    assert (meta["tool_success_rate"], meta["linkage_failures"], meta["source_category"], a.task.description) == (0.75, 1, "c", "task 0") and a.steps[1].observations[0].output_summary == "done"


def test_dataset_with_too_many_errors(spark, tmp_path):
    lines = [json.dumps(row(i)) for i in range(9)] + ["{broken"] * 2
    (tmp_path / "d.jsonl").write_text("\n".join(lines))
    with pytest.raises(datasets.ImportFailed):
        datasets.load(spark, str(tmp_path), "d")
    (tmp_path / "d.jsonl").write_text("\n".join(lines[:6] + ["{broken"] * 2))
    assert datasets.load(spark, str(tmp_path), "d").count() == 6
    assert datasets.adapter("shards") is not None
    with pytest.raises(KeyError):
        datasets.adapter("nothing")


def event(kind, content, **more):
    return json.dumps({"type": kind, "sessionId": "s", "message": {"role": kind, "content": content}, **more})


def use(i, name, **args):
    return {"type": "tool_use", "id": i, "name": name, "input": args}


def test_subagents_go_to_their_description(spark, tmp_path):
    sub = tmp_path / "s" / "subagents"
    sub.mkdir(parents=True)
    calls = [use("c1", "Task", description="look", subagent_type="Explore"), use("c2", "Task", description="other", subagent_type="Critic")]
    (tmp_path / "s.jsonl").write_text("\n".join([event("user", "go"), event("assistant", calls), event("assistant", [{"type": "text", "text": "end"}])]))
    (sub / "a.jsonl").write_text(event("assistant", [{"type": "text", "text": "from a"}]))
    (sub / "b.jsonl").write_text(event("assistant", [{"type": "text", "text": "from b"}]))
    (sub / "b.meta.json").write_text(json.dumps({"description": "look"}))
    got = [(r.step_index, r.content, r.call_type, r.agent_role, r.parent_step) for r in transcripts.parse(spark, str(tmp_path)).orderBy("step_index").collect()]
    assert [g[1] for g in got if g[2] == "subagent"] == ["from a", "from b"] or [g[1] for g in got if g[2] == "subagent"] == ["from b", "from a"]
    assert {(g[1], g[3]) for g in got if g[2] == "subagent"} == {("from b", "explore"), ("from a", "critic")}
    caller = next(g[0] for g in got if g[1] == "" and g[3] == "main")
    assert {g[4] for g in got if g[2] == "subagent"} == {caller}


def test_blank_lines_count_for_the_share_of_bad_ones(spark, tmp_path):
    good = event("user", "x")
    (tmp_path / "a.jsonl").write_text("\n".join([good] * 18 + ["", "{bad"]) + "\n")
    assert transcripts.rejected_files(transcripts.events(transcripts.read_lines(spark, str(tmp_path)))).count() == 0
    assert transcripts.parse(spark, str(tmp_path)).count() == 18


def test_snippets(spark):
    rows = [("Read", {"file_path": "a.py", "offset": 5}, "x\ny", None), ("Read", {"file_path": "a.py", "offset": 0}, "x", None), ("Read", {"file_path": "a.py"}, "x", None), ("Edit", {"file_path": "b.go", "new_string": "n"}, "ok", None), ("Write", {"file_path": "c", "content": "1\n2\n"}, "ok", None)]
    rows += [("Grep", {"pattern": "p"}, "x", {"matches": [{"file_path": "m.py"}, {"path": "n.py"}, {"other": 1}]}), ("Bash", {"command": "ls"}, "x", None), ("Read", {}, "x", None)]
    df = spark.createDataFrame([(k, t, json.dumps(i), c, json.dumps(r) if r else None) for k, (t, i, c, r) in enumerate(rows)], "k int, tool_name string, input string, content string, raw string")
    got = sorted((r.k, r.file_path, r.start_line or 0, r.end_line or 0, r.text or "") for r in transcripts.snippets(df, lambda p: F.lit("l")).collect())
    assert got == [(0, "a.py", 5, 6, "x\ny"), (1, "a.py", 0, 0, "x"), (2, "a.py", 1, 1, "x"), (3, "b.go", 0, 0, "n"), (4, "c", 1, 3, "1\n2\n"), (5, "m.py", 0, 0, ""), (5, "n.py", 0, 0, "")]


def test_outcome_and_version_control(spark):
    df = spark.createDataFrame([("end_turn", "main", None), ("error_max_turns", "HEAD", "abc"), (None, None, None), ("max_tokens", None, "abc")], "r string, b string, s string")
    got = [(r.o.success, r.o.signal_confidence, r.v.type, r.v.branch, r.v.base_commit) for r in df.select(transcripts.outcome(F.col("r")).alias("o"), transcripts.version_control(F.col("b"), F.col("s")).alias("v")).collect()]
    assert got == [(None, "inferred", "git", "main", None), (False, "inferred", "git", None, "abc"), (None, "derived", "none", None, None), (None, "inferred", "git", None, "abc")]


def test_staging_sidecar_and_export(spark, make_traces, tmp_path):
    f = str(tmp_path / "d")
    assert shards.read_sidecar(spark, f, "persona string, avg_score double") is None
    shards.write_sidecar(spark.createDataFrame([("rl", 50.5)], "persona string, avg_score double"), f)
    assert [tuple(r) for r in shards.read_sidecar(spark, f, "persona string, avg_score double").collect()] == [("rl", 50.5)]
    t = make_traces([{"row_id": 1, "session_id": "s", "steps": [{"role": "agent", "content": "x", "observations": [{"error": "e"}]}]}, {"row_id": 2}])
    shards.stage(t.select("row_id", "session_id"), f)
    assert spark.read.json(f"{f}/staging").count() == 2
    shards.export(t, f"{f}/out")
    lines = [json.loads(r.value) for r in spark.read.text(f"{f}/out").collect()]
    assert len(lines) == 1 and lines[0]["steps"][0]["results"][0]["content"] == "[error: e]" and lines[0]["agent"]["name"] == "unknown"


def test_imports_of_four_languages(spark):
    text = "import numpy\nfrom flask import x\nconst a = require('left-pad')\n  12→require 'nokogiri'\nimport \"github.com/a/b\"\n\t\"gopkg.in/yaml.v3\"\nimport os\n\"plain.text\""
    got = spark.createDataFrame([(text,)], "t string").selectExpr(enrich.imports(enrich.SPARK, "t")).first()[0]
    assert got == ["flask", "github.com/a/b", "gopkg.in/yaml.v3", "left-pad", "nokogiri", "numpy"]
