"""Queries of the statistics operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.operators import stats
from spanforge.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def _t(s: SparkSession, d: str, schema: str) -> DataFrame:
    return table(s, d, "traces", schema)


_CARD = "metrics struct<total_steps:bigint, total_input_tokens:bigint, total_output_tokens:bigint, estimated_cost_usd:double>, steps array<struct<step_index:bigint>>, timestamp_start string, timestamp_end string, outcome struct<success:boolean>"


def interval_commits(s: SparkSession, d: str) -> DataFrame:
    """Sessions: a customer's orders of a day's span; commits: their later order dates (tables of the star schema)."""
    o = table(s, d, "orders")
    us = F.unix_micros(F.col("o_orderdate").cast("timestamp"))
    sessions = o.select(F.col("o_orderkey").alias("session_id"), F.col("o_custkey").alias("repo"), us.alias("start_us"), (us + 30 * 86_400_000_000).alias("end_us"))
    commits = o.select(F.col("o_custkey").alias("repo"), F.col("o_orderkey").alias("commit_id"), us.alias("at_us"))
    return stats.interval_commits(sessions, commits, 30 * 86_400_000_000)


def step_tree(s: SparkSession, d: str) -> DataFrame:
    return stats.step_tree(_t(s, d, "row_id bigint, steps array<struct<step_index:bigint, parent_step:bigint>>"))


def upsert(s: SparkSession, d: str) -> DataFrame:
    snaps = stats.snapshots(table(s, d, "events"))
    old, new = snaps.where(F.col("event_id") % 2 == 0), snaps.where(F.col("event_id") % 2 == 1)
    return stats.upsert(old, new)


QUERIES: dict[str, Query] = {
    "card_dataset": lambda s, d: stats.dataset_card(_t(s, d, _CARD)),
    "card_models": lambda s, d: stats.histogram(_t(s, d, "agent struct<model:string>"), F.col("agent.model"), "model"),
    "card_agents": lambda s, d: stats.histogram(_t(s, d, "agent struct<name:string>"), F.col("agent.name"), "agent"),
    "card_top_dependencies": lambda s, d: stats.top_dependencies(_t(s, d, "dependencies array<string>")),
    "card_tools": lambda s, d: stats.tool_stats(_t(s, d, "steps array<struct<tool_calls:array<struct<tool_call_id:string, tool_name:string>>, observations:array<struct<source_call_id:string, error:string>>>>")),
    "card_macro_average": lambda s, d: stats.macro_average(_t(s, d, "task struct<repository:string>, steps array<struct<step_index:bigint>>")),
    "card_rollup": lambda s, d: stats.rollup(_t(s, d, "agent struct<name:string>, metrics struct<total_input_tokens:bigint>, outcome struct<success:boolean>")),
    "state_latest": lambda s, d: stats.latest_state(table(s, d, "trace_state")),
    "state_stage_counts": lambda s, d: stats.stage_counts(_t(s, d, "trace_id string"), table(s, d, "trace_state")),
    "state_uploads_by_day": lambda s, d: stats.uploads_by_day(table(s, d, "trace_state")),
    "state_new_hashes": lambda s, d: stats.new_hashes(_t(s, d, "batch_no bigint, content_hash string")),
    "snap_latest": lambda s, d: stats.latest_snapshot(stats.snapshots(table(s, d, "events"))),
    "snap_upsert": upsert,
    "snap_series": lambda s, d: stats.series(stats.snapshots(table(s, d, "events")), 14),
    "snap_freshness": lambda s, d: stats.freshness(stats.snapshots(table(s, d, "events"))),
    "event_timeline": lambda s, d: stats.timeline(table(s, d, "events")),
    "event_recent_k": lambda s, d: stats.recent_k(table(s, d, "events")),
    "event_first_last": lambda s, d: stats.first_last(table(s, d, "events")),
    "event_alternation": lambda s, d: stats.alternation(table(s, d, "events")),
    "interval_commits": interval_commits,
    "step_tree": step_tree,
}

_SNAPS = "SELECT user_id AS project, event_type AS metric, strftime(ts, '%Y-%m-%d') AS bucket, value, ts AS as_of, event_id FROM events"
_STEP = "SELECT row_id, unnest(steps) AS s FROM traces"
_LATEST = """SELECT trace_id, lower(trim(status)) AS status, created_at, uploaded_at, error FROM trace_state
 QUALIFY row_number() OVER (PARTITION BY trace_id ORDER BY created_at DESC NULLS LAST, lower(trim(status)) DESC NULLS LAST, uploaded_at DESC NULLS LAST, error DESC NULLS LAST) = 1"""
ORACLE: dict[str, str] = {
    "card_dataset": """SELECT count(*) AS n_traces, sum(steps)::BIGINT AS total_steps, sum(tokens)::BIGINT AS total_tokens, min(lo) AS first_day, max(hi) AS last_day, round_even(avg(steps), 0) AS avg_steps,
 round_even(avg(ok) * 100, 1) AS success_rate, round_even(avg(cost), 2) AS avg_cost, round_even(sum(cost), 2) AS total_cost FROM (
 SELECT coalesce(nullif(metrics.total_steps, 0), len(steps), 0) AS steps, coalesce(metrics.total_input_tokens, 0) + coalesce(metrics.total_output_tokens, 0) AS tokens,
 least(left(timestamp_start, 10), left(timestamp_end, 10)) AS lo, greatest(left(timestamp_start, 10), left(timestamp_end, 10)) AS hi, outcome.success::INT AS ok, metrics.estimated_cost_usd AS cost FROM traces)""",
    "card_models": "SELECT coalesce(agent.model, 'unknown') AS model, count(*) AS n FROM traces GROUP BY ALL",
    "card_agents": "SELECT coalesce(agent.name, 'unknown') AS agent, count(*) AS n FROM traces GROUP BY ALL",
    "card_top_dependencies": "SELECT dependency, count(*) AS n FROM (SELECT unnest(list_distinct(dependencies)) AS dependency FROM traces) WHERE length(dependency) > 1 AND NOT regexp_matches(dependency, '^[&|;<>!]+$') GROUP BY ALL ORDER BY n DESC, dependency LIMIT 10",
    "card_tools": f"""SELECT tool, count(*) AS n, count(error) AS n_errors, round_even(1 - count(error) / count(*), 3) AS success_rate FROM (
 SELECT coalesce(c.tool_name, 'unknown') AS tool, list_filter(s.observations, lambda o: o.source_call_id = c.tool_call_id)[1].error AS error FROM (SELECT s, unnest(s.tool_calls) AS c FROM ({_STEP}))) GROUP BY ALL""",
    "card_macro_average": "SELECT count(*) AS n_groups, round_even(avg(m), 4) AS macro_avg, round_even(sum(m * n) / sum(n), 4) AS micro_avg FROM (SELECT task.repository AS r, avg(coalesce(len(steps), 0)) AS m, count(*) AS n FROM traces GROUP BY ALL)",
    "card_rollup": "SELECT agent, count(*) AS n, sum(tokens)::BIGINT AS tokens, round_even(avg(ok), 4) AS success_rate FROM (SELECT coalesce(agent.name, 'unknown') AS agent, coalesce(metrics.total_input_tokens, 0) AS tokens, outcome.success::INT AS ok FROM traces) GROUP BY ROLLUP (agent)",
    "state_latest": _LATEST,
    "state_stage_counts": f"SELECT coalesce(status, 'inbox') AS status, count(*) AS n FROM (SELECT DISTINCT trace_id FROM traces WHERE trace_id IS NOT NULL) LEFT JOIN ({_LATEST}) USING (trace_id) GROUP BY ALL",
    "state_uploads_by_day": "SELECT coalesce(left(uploaded_at, 10), strftime(make_timestamp((floor(created_at) * 1000000)::BIGINT), '%Y-%m-%d')) AS day, count(*) AS n FROM trace_state WHERE lower(trim(status)) = 'uploaded' GROUP BY ALL",
    "state_new_hashes": """WITH k AS (SELECT batch_no, regexp_replace(lower(trim(content_hash)), '^sha256:', '') AS h0 FROM traces),
 v AS (SELECT batch_no, CASE WHEN regexp_matches(h0, '^[0-9a-f]{64}$') AND h0 <> repeat(left(h0, 1), 64) THEN h0 END AS h FROM k), f AS (SELECT h, min(batch_no) AS fb FROM v WHERE h IS NOT NULL GROUP BY ALL)
 SELECT batch_no, count(*) AS n_rows, coalesce(sum((fb < batch_no)::INT), 0)::BIGINT AS n_known FROM v LEFT JOIN f USING (h) GROUP BY ALL""",
    "snap_latest": f"SELECT project, metric, value, as_of, bucket FROM ({_SNAPS}) QUALIFY row_number() OVER (PARTITION BY project, metric ORDER BY as_of DESC, event_id DESC) = 1",
    "snap_upsert": f"SELECT project, metric, bucket, value, as_of FROM ({_SNAPS}) QUALIFY row_number() OVER (PARTITION BY project, metric, bucket ORDER BY event_id % 2 DESC, as_of DESC, event_id DESC) = 1",
    "snap_series": f"SELECT metric, bucket, round_even(sum(value), 4) AS value, count(*) AS n FROM ({_SNAPS}) WHERE as_of > (SELECT max(ts) FROM events) - INTERVAL 14 DAY GROUP BY ALL",
    "snap_freshness": "SELECT *, behind_minutes <= 240 AS fresh FROM (SELECT metric, last_as_of, floor((epoch_us(max(last_as_of) OVER ()) - epoch_us(last_as_of)) / 60000000)::BIGINT AS behind_minutes FROM (SELECT event_type AS metric, max(ts) AS last_as_of FROM events GROUP BY ALL))",
    "event_timeline": """SELECT event_id, round_even((epoch_us(ts) - epoch_us(min(ts) OVER (PARTITION BY user_id))) / 1000000, 3) AS offset_s,
 round_even(coalesce(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0), 2) AS value_before FROM events""",
    "event_recent_k": "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC)::INT AS rank FROM events QUALIFY rank <= 5",
    "event_first_last": "SELECT user_id, arg_min(event_type, (ts, event_id)) AS first_type, arg_max(event_type, (ts, event_id)) AS last_type, count(*) AS n FROM events GROUP BY ALL",
    "event_alternation": "SELECT user_id, coalesce(round_even(1 - sum(same) / count(same), 4), 1.0) AS ratio FROM (SELECT user_id, (lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) = event_type)::INT AS same FROM events) GROUP BY ALL",
    "interval_commits": """SELECT s.o_orderkey AS session_id, arg_max(c.o_orderkey, (c.o_orderdate, c.o_orderkey)) AS commit_id, count(*) AS n_commits FROM orders s JOIN orders c
 ON s.o_custkey = c.o_custkey AND c.o_orderdate BETWEEN s.o_orderdate AND s.o_orderdate + INTERVAL 30 DAY GROUP BY ALL""",
    "step_tree": """WITH RECURSIVE p AS (SELECT row_id, (i - 1)::INT AS step_pos, (list_position(list_transform(steps, lambda x: x.step_index), steps[i].parent_step) - 1)::INT AS up
  FROM (SELECT row_id, steps, unnest(range(1, len(steps) + 1)) AS i FROM traces)),
 n AS (SELECT row_id, step_pos, CASE WHEN up <> step_pos THEN up END AS up FROM p),
 w AS (SELECT row_id, step_pos, step_pos AS root_pos, 0 AS depth FROM n WHERE up IS NULL
  UNION ALL SELECT n.row_id, n.step_pos, w.root_pos, w.depth + 1 FROM n JOIN w ON n.row_id = w.row_id AND n.up = w.step_pos)
 SELECT n.row_id, n.step_pos, coalesce(w.root_pos, n.step_pos) AS root_pos, coalesce(w.depth, 0) AS depth FROM n LEFT JOIN w USING (row_id, step_pos)""",
}
