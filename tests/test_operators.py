"""Reference operators that SQL does not cover, against small expectations or brute force."""

import json
import random

from spanforge.operators import enrich, quality, stats
from spanforge.sources import conversations, manifests, shards, transcripts
from spanforge.streaming import pipelines


def edit(i, tool, **arg):
    return {"tool_call_id": i, "tool_name": tool, "input": json.dumps(arg)}


def test_attribution_follows_file_text(make_traces):
    steps = [
        {"tool_calls": [edit("r", "Read", file_path="a.py")], "observations": [{"source_call_id": "r", "content": "one\ntwo\nthree"}]},
        {"tool_calls": [edit("e", "Edit", file_path="a.py", old_string="two", new_string="2\n2b")]},
        {"tool_calls": [edit("e", "Edit", file_path="a.py", old_string="three", new_string="3")]},
        {"tool_calls": [edit("w", "Write", file_path="b.py", content="x\ny"), {"tool_call_id": "q", "tool_name": "Edit", "input": "no json"}, edit("n", "Edit", old_string="x", new_string="y")]},
        None,
    ]
    got = sorted((r.file_path, r.start_line, r.end_line, r.confidence) for r in enrich.attribution(make_traces([{"row_id": 1, "steps": steps}, {"row_id": 2}])).collect())
    assert got == [("a.py", 2, 3, "medium"), ("a.py", 4, 4, "medium"), ("b.py", 1, 2, "high")]
    assert enrich.confidence([(1, 5), (5, 6)]) == "low"


def test_commit_in_call(make_traces):
    ok = {"tool_calls": [edit("c", "Bash", command='git commit -m "Add x"')], "observations": [{"source_call_id": "c", "content": "[main (root-commit) abc1234] Add x\n 1 file changed"}]}
    bad = {"tool_calls": [edit("c", "Bash", command="git commit")], "observations": [{"source_call_id": "c", "content": "nothing to commit"}]}
    t = enrich.calls(make_traces([{"row_id": 1, "steps": [ok, bad]}]), *[f"{e} AS {n}" for n, e in enrich.commits(enrich.SPARK).items()])
    assert [(r.is_commit, r.sha, r.subject) for r in t.orderBy("step_pos").collect()] == [(True, "abc1234", "Add x"), (True, None, None)]


def test_quality_of_good_and_empty_records(make_traces):
    step = {"role": "user", "content": "hello there", "step_index": 1, "call_type": "main", "timestamp": "2025-01-01T00:00:00Z"}
    good = {
        "row_id": 1, "schema_version": "0.2.0", "trace_id": "a" * 20 + "-" + "b" * 15, "content_hash": "c" * 64, "agent": {"name": "x", "version": "1"}, "timestamp_start": "t", "timestamp_end": "t",
        "steps": [step, {**step, "role": "agent", "step_index": 2, "reasoning_content": "r", "model": "m", "token_usage": {"input_tokens": 1, "output_tokens": 1}}],
    }
    res = quality.check_results(make_traces([good, {"row_id": 2}]))
    assert res.count() == 2 * 62
    score = {(r.row_id, r.check_name): (r.passed, r.score) for r in res.collect()}
    assert score[(1, "C8")] == (True, 1.0) and score[(1, "T1")] == (True, 1.0) and score[(2, "C6")] == (False, 0.0)
    s = {(r.row_id, r.persona): r.total_score for r in quality.trace_scores(make_traces([good, {"row_id": 2}])).collect()}
    assert all(s[(1, p)] > s[(2, p)] for p in ("conformance", "training", "analytics"))
    custom = [quality.Check("X", "mine", "c", 1.0, "n_steps = 0", "n_steps > 1", "1.0")]
    got = {r.row_id: (r.total_score, r.skipped) for r in quality.trace_scores(make_traces([good, {"row_id": 2}]), custom).collect()}
    assert got == {1: (100.0, False), 2: (0.0, True)}


def test_step_tree_orphans_and_cycles(make_traces):
    step = lambda i, up: {"step_index": i, "parent_step": up}
    chain = {"row_id": 1, "steps": [step(0, None), *[step(i, i - 1) for i in range(1, 40)], step(50, 99), step(60, 60), None]}
    cycle = {"row_id": 2, "steps": [step(1, 2), step(2, 1), step(3, 2), step(4, None), step(5, 4)]}
    got = {(r.row_id, r.step_pos): (r.root_pos, r.depth) for r in stats.step_tree(make_traces([chain, cycle, {"row_id": 3}, {"row_id": 4, "steps": []}])).collect()}
    assert got == {(1, i): (0, i) for i in range(40)} | {(1, 40): (40, 0), (1, 41): (41, 0), (1, 42): (42, 0)} | {(2, 0): (0, 0), (2, 1): (1, 0), (2, 2): (2, 0), (2, 3): (3, 0), (2, 4): (3, 1)}


def test_interval_join_against_brute_force(spark):
    r = random.Random(1)
    sessions = [(i, r.choice("ab"), a := r.randint(0, 5000), a + r.randint(-10, 900)) for i in range(60)]
    commits = [(r.choice("ab"), i, r.randint(0, 6000)) for i in range(80)]
    want = {}
    for sid, repo, a, b in sessions:
        hit = [(t, c) for rp, c, t in commits if rp == repo and a <= t <= b]
        if hit:
            want[sid] = (max(hit)[1], len(hit))
    s = spark.createDataFrame(sessions, "session_id bigint, repo string, start_us bigint, end_us bigint")
    c = spark.createDataFrame(commits, "repo string, commit_id bigint, at_us bigint")
    assert {x.session_id: (x.commit_id, x.n_commits) for x in stats.interval_commits(s, c, 250).collect()} == want


def line(**kw):
    return json.dumps(kw)


def test_transcript_files(spark, tmp_path):
    d = tmp_path / "p"
    (d / "s1" / "subagents").mkdir(parents=True)
    use = lambda i, name="Bash": {"type": "tool_use", "id": i, "name": name, "input": {"command": "ls"}}
    (d / "s1.jsonl").write_text(
        "\n".join(
            [
                line(type="user", sessionId="s1", timestamp="2025-01-01T00:00:00Z", cwd="/home/x", message={"role": "user", "content": "do it"}),
                "",
                line(type="assistant", message={"role": "assistant", "model": "m", "content": [{"type": "text", "text": "ok"}, {"type": "thinking", "thinking": "", "signature": "s"}, use("c1"), use("t1", "Task")], "usage": {"input_tokens": 5, "output_tokens": 50}}),
                line(type="user", message={"role": "user", "content": [{"type": "tool_result", "tool_use_id": "c1", "content": "old"}]}),
                line(type="user", toolUseResult={"exitCode": 1, "durationSeconds": 2}, message={"role": "user", "content": [{"type": "tool_result", "tool_use_id": "c1", "content": [{"type": "text", "text": "new"}]}]}),
                line(type="assistant", isMeta=True, message={"role": "assistant", "content": "warm"}),
                line(event="Stop"),
            ]
        )
    )
    (d / "s1" / "subagents" / "agent-t1.jsonl").write_text(line(type="user", message={"role": "user", "content": "sub"}))
    (d / "bad.jsonl").write_text("\n".join(["{", line(type="user", message={"role": "user", "content": "x"})]))
    (d / "empty.jsonl").write_text("")
    got = transcripts.parse(spark, str(d)).orderBy("step_index").collect()
    assert [(r.step_index, r.role, r.content, r.call_type, r.depth) for r in got] == [(1, "user", "do it", "main", 0), (2, "user", "sub", "subagent", 1), (3, "agent", "ok", "main", 0), (4, "agent", "warm", "warmup", 0)]
    o = got[2].observations
    assert (o[0].content, o[0].error, got[2].tool_calls[0].duration_ms) == ("new", "exit_code:1", 2000) and o[1].error == "no_result"
    assert got[2].reasoning_content.startswith("[redacted")
    parsed = transcripts.events(transcripts.read_lines(spark, str(d)))
    assert [r.file.rsplit("/", 1)[1] for r in transcripts.rejected_files(parsed).collect()] == ["bad.jsonl"]
    m = {r.file.rsplit("/", 1)[1]: r for r in transcripts.sessions(parsed).collect()}["s1.jsonl"]
    assert (m.session_id, m.task, m.model, m.n_stops) == ("s1", "do it", "m", 1)


def test_conversation_fold(spark):
    turns = [
        ("system", "sys"), ("human", "hi"),
        ("gpt", '<think> a </think><think> </think>x<tool_call>{"name": "terminal", "arguments": "{\\"command\\": \\"ls\\"}"}</tool_call><tool_call>nope</tool_call><tool_call>{"name": "q", "arguments": "raw"}</tool_call>'),
        ("tool", '<tool_response>{"content": "r1"}</tool_response><tool_response>plain</tool_response><tool_response>[1]</tool_response>'),
    ]
    s = conversations.fold_turns(turns)
    assert [x["role"] for x in s] == ["user", "agent"] and s[1]["reasoning_content"] == "a" and s[1]["content"] == "x"
    assert [c["tool_name"] for c in s[1]["calls"]] == ["Bash", "q"] and json.loads(s[1]["calls"][1]["input"]) == {"raw": "raw"}
    assert [o["source_call_id"] for o in s[1]["observations"]] == ["tc_1_0", "tc_1_2", None] and s[1]["observations"][2]["error"] == "unlinked_response"
    df = spark.createDataFrame([(1, turns), (2, None), (3, [])], "id int, conversations array<struct<from:string, value:string>>")
    assert conversations.conversation_steps(df, "id").count() == 2


def test_manifests(spark):
    files = [
        ("x/package.json", '{"dependencies": {"b": "1"}, "devDependencies": {"a": "2"}}'), ("requirements.txt", "numpy>=1\n# c\n-e .\npandas\n"), ("go.mod", "module m\nrequire (\n\tgithub.com/a/b v1.0.0\n)\n"),
        ("Gemfile", "gem 'rails', '~> 7'\n"), ("pyproject.toml", '[project]\ndependencies = [\n "flask>=2",\n "x",\n]\n'), ("other.txt", "zzz"), ("package.json", "not json"), ("package.json", None),
    ]
    got = {(r.file, r.dependency) for r in manifests.dependencies(spark.createDataFrame(files, "file string, text string")).collect()}
    assert got == {("x/package.json", "a"), ("x/package.json", "b"), ("requirements.txt", "numpy"), ("requirements.txt", "pandas"), ("go.mod", "github.com/a/b"), ("Gemfile", "rails"), ("pyproject.toml", "flask"), ("pyproject.toml", "x")}


def test_shards_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", "x"), (2, None, None)], "row_id bigint, content_hash string, v string")
    folder = str(tmp_path / "shards")
    shards.append(df, folder)
    (tmp_path / "shards" / "traces_bad.json").write_text("{broken\n")
    assert sorted(tuple(r) for r in shards.read(spark, folder, df.schema).collect()) == [(1, "a", "x"), (2, None, None)]
    more = spark.createDataFrame([(3, "a"), (4, "b"), (5, "b"), (6, None), (7, None)], "row_id bigint, content_hash string")
    assert sorted(r.row_id for r in shards.fresh(more, df).collect()) == [4, 6, 7]
    h = shards.content_hash(df)
    assert df.select(h).distinct().count() == 2
    card = shards.card({"n_traces": 2}, {"models": [("m", 2)]})
    assert shards.replace_section("intro\n" + card + "end", shards.card({"n_traces": 3}, {})).startswith("intro") and "| n_traces | 3 |" in shards.replace_section("intro\n" + card + "end", shards.card({"n_traces": 3}, {}))


def test_closed_sessions_stream(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    rows = [("a", "2025-01-01 00:00:00", "x"), ("a", "2025-01-01 00:05:00", "Stop"), ("b", "2025-01-01 00:01:00", "x")]
    spark.createDataFrame(rows, "session_id string, t string, event string").selectExpr("session_id", "CAST(t AS timestamp) AS ts", "event").coalesce(1).write.mode("append").parquet(str(src))
    spark.createDataFrame([("c", "2025-01-01 09:00:00", "x")], "session_id string, t string, event string").selectExpr("session_id", "CAST(t AS timestamp) AS ts", "event").coalesce(1).write.mode("append").parquet(str(src))
    stream = pipelines.landed(spark, str(src), "session_id string, ts timestamp, event string", per_trigger=1)
    got = {(r.session_id, r.closed_by): r.n_events for r in pipelines.drain(pipelines.close_sessions(stream), "close").collect()}
    assert got[("a", "stop")] == 2 and ("c", "idle") not in got


def test_ledger(spark):
    listing = spark.createDataFrame([("a", 1, 10.0, 100), ("b", 2, 10.0, 50), ("c", 9, 10.0, 70), ("d", 4, 11.0, 90)], "file_path string, inode bigint, mtime double, size bigint")
    ledger = spark.createDataFrame([("b", 2, 10.0, 50), ("c", 3, 9.0, 70), ("d", 4, 10.0, 40)], "file_path string, inode bigint, mtime double, last_byte_offset bigint")
    assert {r.file_path: r.from_offset for r in pipelines.new_files(listing, ledger).collect()} == {"a": 0, "c": 0, "d": 40}
