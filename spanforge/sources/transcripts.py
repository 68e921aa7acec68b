"""Raw session transcripts (one JSON event per line) to steps.

A transcript file is read as one row and split by line, which keeps line
numbers without a sort; sessions are files of megabytes.  Events are parsed by
``from_json`` with open parts left as text, results meet their calls by an
equi-join on (file, id), sub-agent files are inlined level by level with array
sort keys, and steps are renumbered by the order of these keys.

Defined results
    * blank lines are skipped; a file with more than ``MAX_BAD`` bad lines is
      rejected (``rejected_files`` names it); an empty file has no steps;
    * of several results of one call the last one holds; a call without result
      has the error ``no_result``;
    * a sub-agent that is its own ancestor is not inlined again; at most
      ``MAX_DEPTH`` levels are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from spanforge.session import cut

MAX_BAD = 0.05
MAX_DEPTH = 10
OBSERVATION_CHARS, SUMMARY_CHARS = 10_000, 200

EVENT = (
    "type string, subtype string, sessionId string, timestamp string, version string, cwd string, gitBranch string, slug string, isMeta boolean, toolUseResult string, message string, "
    "description string, model string, permissionMode string, stop_reason string, total_cost_usd double, duration_ms bigint, event string, data string, _bad string"
)
MESSAGE = "role string, model string, content string, usage struct<input_tokens:bigint, output_tokens:bigint, cache_read_input_tokens:bigint, cache_creation_input_tokens:bigint>"
BLOCKS = "array<struct<type:string, text:string, thinking:string, signature:string, id:string, name:string, input:string, tool_use_id:string, content:string, is_error:boolean>>"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, raw) of every line; blank ones count for the share of bad lines and are dropped after it."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.jsonl").select(F.col("_metadata.file_path").alias("file"), "value")
    # the end of the last line begins no further one
    return files.select("file", F.posexplode(F.split(F.regexp_replace("value", r"\r?\n\z", ""), r"\r\n|\n|\r")).alias("line_no", "raw"))


def events(lines: DataFrame) -> DataFrame:
    """Parsed events; ``bad`` marks lines that are no JSON object."""
    e = F.from_json("raw", EVENT, {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"})
    bad = (F.trim("raw") != "") & (F.col("e").isNull() | F.col("e._bad").isNotNull() | ~F.trim("raw").startswith("{"))
    return lines.withColumn("e", e).withColumn("bad", bad)


def rejected_files(parsed: DataFrame, limit: float = MAX_BAD) -> DataFrame:
    share = F.avg(F.col("bad").cast("double"))
    return parsed.groupBy("file").agg(share.alias("bad_share")).where(F.col("bad_share") > limit)


def messages(parsed: DataFrame) -> DataFrame:
    """User and assistant events with their blocks; plain text content is one text block."""
    m = F.from_json("e.message", MESSAGE)
    good = parsed.where(~F.col("bad") & F.col("e.type").isin("user", "assistant")).withColumn("m", m)
    text = F.array(F.struct(F.lit("text").alias("type"), F.col("m.content").alias("text")))
    blocks = F.when(F.col("m.content").startswith("["), F.from_json("m.content", BLOCKS))
    return good.withColumn("blocks", F.coalesce(blocks, F.when(F.col("m.content").isNotNull(), F.from_json(F.to_json(text), BLOCKS)), F.from_json(F.lit("[]"), BLOCKS)))


def _kind(kind: str) -> Column:
    return F.filter("blocks", lambda b: b["type"] == kind)


def _plain(content: Column) -> Column:
    """Text of a result: a string, or text blocks joined by line ends."""
    parts = F.from_json(content, "array<struct<type:string, text:string>>")
    return F.when(content.startswith("["), F.array_join(F.transform(F.filter(parts, lambda p: p["type"] == "text"), lambda p: p["text"]), "\n")).otherwise(content)


def results(msgs: DataFrame) -> DataFrame:
    """The last result of every call: file, id, content, error, duration_ms."""
    r = msgs.select("file", "line_no", F.col("e.toolUseResult").alias("raw"), F.explode(_kind("tool_result")).alias("b"))
    last = r.groupBy("file", F.col("b.tool_use_id").alias("id")).agg(F.max_by(F.struct("b.content", "b.is_error", "raw"), "line_no").alias("r"))
    num = lambda k: F.get_json_object("r.raw", f"$.{k}").try_cast("double")
    error = (
        F.when(F.col("r.is_error"), "tool_error")
        .when(F.coalesce(num("exitCode"), F.lit(0.0)) != 0, F.concat(F.lit("exit_code:"), num("exitCode").cast("bigint").cast("string")))
        .when(F.get_json_object("r.raw", "$.interrupted") == "true", "interrupted")
    )
    took = F.coalesce(num("durationMs"), num("durationSeconds") * 1000, num("duration") * 1000).cast("bigint")
    return last.select("file", "id", F.left(_plain(F.col("r.content")), F.lit(OBSERVATION_CHARS)).alias("content"), error.alias("error"), took.alias("duration_ms"))


def steps(msgs: DataFrame) -> DataFrame:
    """Steps of each file in its own order: file, line_no and the step's fields.

    Messages that hold nothing but results give no step.
    """
    texts = F.array_join(F.transform(_kind("text"), lambda b: b["text"]), "\n")
    thoughts = F.array_join(F.transform(_kind("thinking"), lambda b: F.when((F.coalesce(b["thinking"], F.lit("")) == "") & b["signature"].isNotNull(), "[redacted: encrypted thinking]").otherwise(b["thinking"])), "\n")
    own = msgs.where(~((F.size("blocks") > 0) & F.forall("blocks", lambda b: b["type"] == "tool_result")))
    agent = F.col("e.type") == "assistant"
    warm = F.coalesce(F.col("e.isMeta"), F.lit(False)) | (agent & (F.coalesce("m.usage.output_tokens", F.lit(0)) <= 10) & (F.trim(texts) == "") & (F.size(_kind("tool_use")) == 0))
    base = own.select(
        "file", "line_no", F.when(agent, "agent").otherwise("user").alias("role"), texts.alias("content"), F.nullif(thoughts, F.lit("")).alias("reasoning_content"), F.col("m.model").alias("model"),
        F.col("e.timestamp").alias("timestamp"), F.when(warm, "warmup").otherwise("main").alias("call_type"), F.col("m.usage").alias("usage"), _kind("tool_use").alias("uses"),
    )
    calls = base.select("file", "line_no", F.posexplode("uses").alias("pos", "u"))
    joined = calls.alias("c").join(results(msgs).alias("r"), (F.col("c.file") == F.col("r.file")) & (F.col("c.u.id") == F.col("r.id")), "left")
    call = F.struct(F.col("u.id").alias("tool_call_id"), F.col("u.name").alias("tool_name"), F.col("u.input").alias("input"), F.col("r.duration_ms").alias("duration_ms"))
    summary = F.when(F.length("r.content") > SUMMARY_CHARS, F.concat(F.left("r.content", F.lit(SUMMARY_CHARS)), F.lit("..."))).otherwise(F.col("r.content"))
    obs = F.struct(F.col("u.id").alias("source_call_id"), F.col("r.content").alias("content"), summary.alias("output_summary"), F.when(F.col("r.id").isNull(), "no_result").otherwise(F.col("r.error")).alias("error"))
    packed = joined.groupBy("c.file", "c.line_no").agg(F.array_sort(F.collect_list(F.struct(F.col("pos"), call.alias("call"), obs.alias("obs")))).alias("x"))  # the calls of one message
    out = base.drop("uses").join(packed, ["file", "line_no"], "left")
    return out.select("*", F.transform("x", lambda v: v["call"]).alias("tool_calls"), F.transform("x", lambda v: v["obs"]).alias("observations")).drop("x")


# Role of a sub-agent by its type.
AGENT_ROLES = {"Explore": "explore", "Plan": "plan", "general-purpose": "general"}
SNIPPET_CHARS, GREP_FILES = 5000, 10


def snippets(calls: DataFrame, language) -> DataFrame:
    """Code that calls read, wrote or found, of rows with tool_name, input, content and raw (the result's own fields).

    Adds a row per snippet: file_path, start_line, end_line, language, text.  A Read starts at its offset (1 if it has
    none, unknown if that is no number above 0), a Write at line 1; an Edit has no lines; a Grep names its first files.
    """
    arg = lambda k: F.get_json_object("input", f"$.{k}")
    path, n = arg("file_path"), lambda t: F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit(""))) + 1
    offset = F.when(arg("offset").isNull(), 1).when(arg("offset").try_cast("double") >= 1, arg("offset").try_cast("double").cast("int"))
    none = F.lit(None).cast("int")
    one = lambda text, start, end: F.array(F.struct(path.alias("file_path"), start.cast("int").alias("start_line"), end.cast("int").alias("end_line"), F.left(text, F.lit(SNIPPET_CHARS)).alias("text")))
    found = F.slice(F.from_json(F.get_json_object("raw", "$.matches"), "array<struct<file_path:string, path:string>>"), 1, GREP_FILES)
    files = F.filter(F.transform(found, lambda m: F.struct(F.coalesce(m["file_path"], m["path"]).alias("file_path"), none.alias("start_line"), none.alias("end_line"), F.lit(None).cast("string").alias("text"))), lambda m: m["file_path"].isNotNull())
    said = lambda k: (F.coalesce(path, F.lit("")) != "") & (F.coalesce(k, F.lit("")) != "")
    rows = (
        F.when((F.col("tool_name") == "Read") & said(F.col("content")), one(F.col("content"), offset, offset + n(F.col("content")) - 1))
        .when((F.col("tool_name") == "Edit") & said(arg("new_string")), one(arg("new_string"), none, none))
        .when((F.col("tool_name") == "Write") & said(arg("content")), one(arg("content"), F.lit(1), n(arg("content"))))
        .when(F.col("tool_name") == "Grep", files)
    )
    keep = [c for c in calls.columns if c not in ("input", "content", "raw")]
    return calls.select(*keep, F.inline(rows)).withColumn("language", language(F.col("file_path")))


def outcome(stop_reason: Column) -> Column:
    """A session's outcome by why it stopped: an error is a failure, all else leaves success open; both are inferred."""
    known = stop_reason.isNotNull()
    return F.struct(
        F.when(stop_reason.isin("error_during_execution", "error_max_turns", "error_max_budget_usd", "error_max_structured_output_retries"), False).alias("success"),
        F.when(known, "result_message").alias("signal_source"), F.when(known, "inferred").otherwise("derived").alias("signal_confidence"), stop_reason.alias("description"),
    )


def version_control(branch: Column, sha: Column) -> Column:
    """git where a branch or a commit is known; HEAD is no branch's name."""
    git = (F.coalesce(branch, F.lit("")) != "") | (F.coalesce(sha, F.lit("")) != "")
    return F.struct(F.when(git, "git").otherwise("none").alias("type"), F.when(git, F.nullif(F.nullif(branch, F.lit("HEAD")), F.lit(""))).alias("branch"), F.nullif(sha, F.lit("")).alias("base_commit"))


def subagent_edges(own: DataFrame, files: DataFrame) -> DataFrame:
    """(file, line_no, call_id, child, agent_role): the sub-agent file that each Task call started.

    ``files``(child, file, description): the sub-agents of a session with the description that their meta file gives.
    A call goes to the file of its description, else to the session's first file; the description is part of the
    join's key, so calls and files of a session are not paired with each other.
    """
    calls = own.select("file", "line_no", F.explode("tool_calls").alias("c")).where(F.col("c.tool_name").isin("Task", "Agent"))
    kind = F.coalesce(F.get_json_object("c.input", "$.subagent_type"), F.lit("general"))
    role = F.coalesce(F.create_map(*[F.lit(x) for kv in AGENT_ROLES.items() for x in kv])[kind], F.lower(kind))
    calls = calls.select("file", "line_no", F.col("c.tool_call_id").alias("call_id"), F.coalesce(F.get_json_object("c.input", "$.description"), F.lit("")).alias("description"), role.alias("agent_role"))
    named = files.where(F.col("description").isNotNull()).groupBy("file", "description").agg(F.min("child").alias("named"))
    first = files.groupBy("file").agg(F.min("child").alias("first"))
    j = calls.join(named, ["file", "description"], "left").join(first, "file")
    return j.select("file", "line_no", "call_id", F.coalesce("named", "first").alias("child"), "agent_role")


def inline_subagents(own: DataFrame, edges: DataFrame, roots: DataFrame) -> DataFrame:
    """All steps of each root session with its sub-agents' steps before the step that calls them.

    ``edges``(file, line_no, call_id, child, agent_role): the file that a call of ``file`` started.
    Adds session, order_key, depth, agent_role and parent_key (the order key of the calling step, null for own steps).
    """
    frames = roots.select(F.col("file").alias("session"), "file", F.expr("CAST(array() AS array<int>)").alias("prefix"), F.array("file").alias("seen"), F.lit(0).alias("depth"), F.lit("main").alias("agent_role"), F.expr("CAST(NULL AS array<int>)").alias("parent_key"))
    calls = edges.select("file", "line_no", "child", F.col("agent_role").alias("role_of_child")).distinct()
    out = frames
    for _ in range(MAX_DEPTH):
        nxt = frames.join(calls, "file").where(~F.array_contains("seen", F.col("child")))
        frames = nxt.select("session", F.col("child").alias("file"), F.concat("prefix", F.array("line_no", F.lit(0))).alias("prefix"), F.concat("seen", F.array("child")).alias("seen"), (F.col("depth") + 1).alias("depth"), F.col("role_of_child").alias("agent_role"), F.concat("prefix", F.array("line_no", F.lit(1))).alias("parent_key"))
        if frames.isEmpty():
            break
        out = out.unionByName(frames)
    keyed = own.join(out.drop("seen"), "file").withColumn("order_key", F.concat("prefix", F.array("line_no", F.lit(1))))
    return keyed.withColumn("call_type", F.when(F.col("depth") > 0, "subagent").otherwise(F.col("call_type"))).drop("prefix")


def renumber(all_steps: DataFrame) -> DataFrame:
    """Steps numbered 1..n within their session by order of emission."""
    w = W.Window.partitionBy("session").orderBy("order_key", "file")
    out = all_steps.withColumn("step_index", F.row_number().over(w).cast("bigint"))
    if "parent_key" not in out.columns:
        return out
    up = out.groupBy("session", F.col("order_key").alias("parent_key")).agg(F.min("step_index").alias("parent_step"))
    return out.join(up, ["session", "parent_key"], "left")


def sessions(parsed: DataFrame) -> DataFrame:
    """Session metadata by order of lines: first values, last values, first task, first and last time."""
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("line_no")))
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("line_no")))
    flat = parsed.where(~F.col("bad")).select("file", "line_no", "e.*").withColumn("m", F.from_json("message", MESSAGE)).withColumn("sha", F.when(F.col("event") == "Stop", F.get_json_object("data", "$.git.sha")))
    flat = flat.withColumn("said", F.when((F.col("type") == "user") & ~F.col("m.content").startswith("["), F.left("m.content", F.lit(500)))).withColumn("any_model", F.coalesce("model", "m.model"))
    return flat.groupBy("file").agg(
        first("sessionId").alias("session_id"), first("slug").alias("slug"), first("version").alias("version"), first("any_model").alias("model"), first("cwd").alias("cwd"), first("gitBranch").alias("branch"),
        last("permissionMode").alias("permission_mode"), last("stop_reason").alias("stop_reason"), last("total_cost_usd").alias("cost_usd"), first("said").alias("task"),
        first("timestamp").alias("timestamp_start"), last("timestamp").alias("timestamp_end"), F.count(F.lit(1)).alias("n_events"),
        F.count_if((F.col("type") == "system") & (F.col("subtype") == "compact_boundary")).alias("n_compactions"), F.count_if(F.col("event") == "Stop").alias("n_stops"),
        F.max_by("sha", F.when(F.col("sha").isNotNull(), F.col("line_no"))).alias("sha"),
    ).withColumns({"os": operating_system(F.col("cwd")), "vcs": version_control(F.col("branch"), F.col("sha")), "outcome": outcome(F.col("stop_reason"))})


def operating_system(cwd: Column) -> Column:
    return F.when(cwd.startswith("/Users/"), "darwin").when(cwd.startswith("/home/") | cwd.startswith("/root/"), "linux").when(cwd.rlike(r"^.:[/\\\\]"), "windows")


def raw_counters(parsed: DataFrame) -> DataFrame:
    """Counters per file that are independent of the step builder."""
    msgs = messages(parsed)
    n = lambda kind: F.sum(F.size(_kind(kind)))
    per = msgs.groupBy("file").agg(
        F.count_if(F.col("e.type") == "user").alias("user_messages"), F.count_if(F.col("e.type") == "assistant").alias("assistant_messages"), n("tool_use").alias("tool_uses"), n("tool_result").alias("tool_results"),
        n("thinking").alias("thinking_blocks"), F.count_if(F.col("m.usage").isNotNull()).alias("with_usage"), F.count_if(F.col("e.timestamp").isNotNull()).alias("with_timestamp"), F.array_sort(F.collect_set("m.model")).alias("models_seen"),
    )
    bad = parsed.groupBy("file").agg(F.count(F.lit(1)).alias("lines"), F.count_if("bad").alias("corrupt_lines"))
    return bad.join(per, "file", "left")


def preservation(raw: DataFrame, built: DataFrame) -> DataFrame:
    """Per file the share of the raw signals that the steps kept, and their weighted mean."""
    got = built.groupBy("file").agg(
        F.count(F.lit(1)).alias("steps"), F.sum(F.coalesce(F.size("tool_calls"), F.lit(0))).alias("calls"), F.sum(F.coalesce(F.size(F.filter("observations", lambda o: ~F.coalesce(o["error"] == "no_result", F.lit(False)))), F.lit(0))).alias("obs"),
        F.count("reasoning_content").alias("thoughts"), F.count("usage").alias("usages"), F.count("timestamp").alias("times"),
    )
    j = raw.join(got, "file", "left")
    ratio = lambda a, b: F.when(F.coalesce(F.col(b), F.lit(0)) == 0, 1.0).otherwise(F.least(F.lit(1.0), F.coalesce(F.col(a), F.lit(0)) / F.col(b)))
    parts = [("calls", "tool_uses", 1.0), ("obs", "tool_results", 0.9), ("thoughts", "thinking_blocks", 0.5), ("usages", "with_usage", 0.8), ("times", "with_timestamp", 0.6)]
    out = j.select("file", *[ratio(a, b).alias(f"{a}_ratio") for a, b, _ in parts])
    total = sum((F.col(f"{a}_ratio") * w for a, _, w in parts), F.lit(0.0)) / sum(w for _, _, w in parts)
    return out.withColumn("overall", F.bround(total, 4))


def parse(spark: SparkSession, path: str) -> DataFrame:
    """Steps of all sessions under ``path``: rejected files left out, sub-agent files inlined, renumbered."""
    parsed = events(read_lines(spark, path))
    # parsed once: files and their steps are used several times below
    parsed = cut(parsed.join(rejected_files(parsed).select("file"), "file", "left_anti").where(F.trim("raw") != ""))
    own = cut(steps(messages(parsed)))
    child = parsed.select("file").distinct().where(F.col("file").contains("/subagents/"))
    meta = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.meta.json").select(F.regexp_replace(F.col("_metadata.file_path"), r"\.meta\.json$", ".jsonl").alias("child"), F.get_json_object("value", "$.description").alias("description"))
    # sub-agents of sub-agents lie in the folder of the session they belong to
    child = child.select(F.col("file").alias("child"), F.regexp_replace("file", r"/subagents/[^/]+$", ".jsonl").alias("file")).join(meta, "child", "left")
    edges = subagent_edges(own, child)
    roots = parsed.select("file").distinct().where(~F.col("file").contains("/subagents/"))
    return renumber(inline_subagents(own, edges, roots))
