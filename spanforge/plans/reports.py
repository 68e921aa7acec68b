"""Queries of the reports, of the dataset import and of what sessions yield; their SQL is written by hand."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.functions.dialect import SPARK
from spanforge.operators import enrich, reports, stats
from spanforge.plans.records import ORACLE as _RECORDS
from spanforge.plans.records import _scores
from spanforge.sources import datasets, shards, transcripts
from spanforge.sources.tables import pick, table

Query = Callable[[SparkSession, str], DataFrame]


def _judged(s: SparkSession, d: str) -> DataFrame:
    """A judge's scores made of the star schema: orders stand for records."""
    return table(s, d, "orders").select(F.col("o_orderkey").alias("row_id"), F.lit("training").alias("persona"), (F.col("o_totalprice") % 100).alias("judge_score")).groupBy("row_id", "persona").agg(F.max("judge_score").alias("judge_score"))


def hybrid_scores(s: SparkSession, d: str) -> DataFrame:
    return reports.hybrid(_scores(s, d), _judged(s, d))


def persona_badges(s: SparkSession, d: str) -> DataFrame:
    mean = _scores(s, d).groupBy("persona").agg(F.bround(F.avg(F.when(~F.col("skipped"), F.col("total_score"))), 1).alias("avg_score"))
    return mean.withColumn("badge", reports.badge(F.col("avg_score")))


def batch_delta(s: SparkSession, d: str) -> DataFrame:
    mean = lambda df: df.groupBy("persona").agg(F.bround(F.avg(F.when(~F.col("skipped"), F.col("total_score"))), 1).alias("avg_score"))
    scores = _scores(s, d)
    return reports.compare_batches(mean(scores.where(F.col("row_id") % 2 == 0)), mean(scores.where(F.col("row_id") % 2 == 1)))


def call_snippets(s: SparkSession, d: str) -> DataFrame:
    calls = enrich.calls(pick(s, d, "traces", "row_id steps.tool_calls steps.observations"), "tool_name", "CASE WHEN try_parse_json(input) IS NOT NULL THEN input END AS input", "content", "CAST(NULL AS string) AS raw")
    return transcripts.snippets(calls, lambda p: F.expr(enrich.language(SPARK, "file_path"))).select("row_id", "step_pos", "call_pos", "file_path", "start_line", "end_line", "text")


def dataset_records(s: SparkSession, d: str) -> DataFrame:
    """Records of conversation rows made from the trace table; completed comes from the record's outcome."""
    t = pick(s, d, "traces", "row_id task.description agent.model outcome.success outcome.reward steps.role steps.content")
    turns = F.transform("steps", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content")))
    rows = t.where(F.col("row_id").isNotNull() & (F.size("steps") > 0)).groupBy("row_id").agg(*[F.first(c).alias(n) for c, n in ((turns, "conversations"), (F.col("task.description"), "prompt"), (F.col("agent.model"), "model"), (F.col("outcome.success"), "completed"))])
    nul = lambda kind: F.lit(None).cast(kind)
    rows = rows.select(
        F.col("row_id").cast("string").alias("row_key"), F.col("row_id").alias("row_index"), "conversations", "prompt", "model", "completed", nul("boolean").alias("partial"), nul("map<string,struct<count:bigint,success:bigint,failure:bigint>>").alias("tool_stats"),
        nul("array<string>").alias("tool_definitions"), F.struct(nul("string").alias("task_source")).alias("source_row"), F.struct(nul("string").alias("timestamp")).alias("metadata"),
        F.struct(nul("bigint").alias("prompt_tokens"), nul("bigint").alias("completion_tokens"), nul("double").alias("estimated_cost_usd")).alias("usage"), *[nul("string").alias(c) for c in ("category", "subcategory", "id")],
    )
    out = datasets.records(rows, "own/set", revision="0123456789abcdef")
    return out.select("session_id", F.col("task.description").alias("task"), "outcome.success", "outcome.signal_source", "outcome.terminal_state")


def merged_outcomes(s: SparkSession, d: str) -> DataFrame:
    """Outcomes with what the last committing call of the record shows, and languages filled in where the record has none."""
    t = pick(s, d, "traces", "row_id outcome environment.language_ecosystem steps.tool_calls steps.observations")
    c = enrich.flat_calls(SPARK)
    sha = enrich.commits(SPARK)["sha"]
    t = t.selectExpr("row_id", "outcome", "environment.language_ecosystem AS languages", f"filter(transform({c}, c -> {sha.replace('content', 'c.content')}), x -> x IS NOT NULL) AS shas", f"{enrich.ecosystem(SPARK)} AS seen")
    t = t.withColumn("sha", F.try_element_at(F.col("shas"), F.lit(-1)))
    out = t.withColumn("o", reports.merge_commit(F.col("outcome"), F.col("sha").isNotNull(), F.col("sha"), F.lit(None).cast("string")))
    return out.select("row_id", "o.committed", "o.commit_sha", "o.success", "o.reward", F.array_join(F.array_sort(F.array_compact(reports.fill_when_empty(F.col("languages"), F.col("seen")))), ",").alias("languages"))


def _snaps(s: SparkSession, d: str) -> DataFrame:
    return stats.snapshots(table(s, d, "events"))


_STATE = "trace_id string, status string, created_at double, uploaded_at string, error string"
QUERIES: dict[str, Query] = {
    f.__name__: f for f in (hybrid_scores, persona_badges, batch_delta, call_snippets, dataset_records, merged_outcomes)
} | {
    "trace_exported": lambda s, d: shards.exchange(pick(s, d, "traces", "session_id trace_id agent metrics steps.role steps.content steps.reasoning_content steps.model steps.tool_calls steps.observations steps.token_usage")).selectExpr(
        "session_id", "agent.name AS agent", "final_metrics.total_steps AS n_steps", "final_metrics.total_prompt_tokens AS tokens", "aggregate(steps, 0L, (a, s) -> a + size(s.tool_calls)) AS n_calls"
    ),
    "exchange_coverage": lambda s, d: shards.coverage(s),
    "trace_detail": lambda s, d: reports.detail(pick(s, d, "traces", "row_id steps.role steps.content steps.tool_calls.tool_call_id"), [3, 5, 8, 13]),
    "trace_judge_summary": lambda s, d: reports.judge_summary(pick(s, d, "traces", "row_id task.description steps.role steps.tool_calls.tool_name dependencies attribution.files.path")),
    "trace_unattributed": lambda s, d: reports.unattributed(pick(s, d, "traces", "row_id environment.vcs.diff attribution.files.path")),
    "trace_edit_conversations": lambda s, d: reports.conversations_of_edits(enrich.attribution(pick(s, d, "traces", "row_id steps.tool_calls steps.observations"))),
    "series_totals": lambda s, d: reports.series_totals(_snaps(s, d)),
    "series_projects": lambda s, d: reports.rows_per_project(_snaps(s, d)),
    "state_by_stage": lambda s, d: reports.by_stage(stats.stage_counts(table(s, d, "traces", "trace_id string"), table(s, d, "trace_state", _STATE))),
    "card_repositories": lambda s, d: reports.largest_first(stats.histogram(pick(s, d, "traces", "task.repository"), F.col("task.repository"), "repository"), "repository"),
    "filter_tagged": lambda s, d: reports.tagged(pick(s, d, "traces", "row_id dependencies task.repository"), "kestrel", "dependencies", "task.repository").select("row_id"),
    "batch_groups": lambda s, d: reports.commit_groups(table(s, d, "traces", "row_id bigint, batch_no bigint, trace_id string")),
    "union_documents": lambda s, d: reports.union_distinct(*[table(s, d, "documents").where(F.col("doc_id") % 3 != k).select("doc_id", "source", F.when(F.lit(k == 0), F.col("n_chars")).otherwise(F.col("n_chars") + 1).alias("version")) for k in (0, 1)], "doc_id", "version"),
}

_P = _RECORDS["quality_scores"]
_MEAN = "round_even(avg(total_score) FILTER (NOT skipped), 1)"
_CALLS = """SELECT row_id, i - 1 AS step_pos, j - 1 AS call_pos, steps[i].tool_calls[j].tool_name AS tool, CASE WHEN json_valid(steps[i].tool_calls[j].input) THEN steps[i].tool_calls[j].input END AS input,
 list_filter(steps[i].observations, lambda o: coalesce(o.source_call_id, '') <> '' AND o.source_call_id = steps[i].tool_calls[j].tool_call_id)[1].content AS content
 FROM (SELECT *, unnest(range(1, len(steps[i].tool_calls) + 1)) AS j FROM (SELECT row_id, steps, unnest(range(1, len(steps) + 1)) AS i FROM traces))"""
_TEXT = "CASE tool WHEN 'Read' THEN content WHEN 'Edit' THEN input ->> '$.new_string' WHEN 'Write' THEN input ->> '$.content' END"
ORACLE: dict[str, str] = {
    "hybrid_scores": f"SELECT row_id, persona, round_even(CASE WHEN j IS NULL THEN total_score ELSE 0.6::DOUBLE * total_score + 0.4::DOUBLE * j END, 1) AS score FROM ({_P}) LEFT JOIN (SELECT o_orderkey AS row_id, 'training' AS persona, max(o_totalprice % 100) AS j FROM orders GROUP BY ALL) USING (row_id, persona)",
    "persona_badges": f"SELECT *, CASE WHEN avg_score >= 80 THEN 'good' WHEN avg_score >= 60 THEN 'fair' WHEN avg_score >= 40 THEN 'weak' ELSE 'poor' END AS badge FROM (SELECT persona, {_MEAN} AS avg_score FROM ({_P}) GROUP BY persona)",
    "batch_delta": f"SELECT persona, a.m AS here, b.m AS there, round_even(a.m - b.m, 1) AS delta FROM (SELECT persona, {_MEAN} AS m FROM ({_P}) WHERE row_id % 2 = 0 GROUP BY persona) a LEFT JOIN (SELECT persona, {_MEAN} AS m FROM ({_P}) WHERE row_id % 2 = 1 GROUP BY persona) b USING (persona)",
    "call_snippets": f"""WITH c AS (SELECT *, coalesce(input ->> '$.file_path', '') AS file_path, {_TEXT} AS t, input ->> '$.offset' AS off FROM ({_CALLS})),
 k AS (SELECT *, length(t) - length(replace(t, chr(10), '')) + 1 AS n, CASE WHEN tool = 'Write' THEN 1 WHEN tool = 'Read' AND off IS NULL THEN 1 WHEN tool = 'Read' AND TRY_CAST(off AS DOUBLE) >= 1 THEN trunc(TRY_CAST(off AS DOUBLE))::INT END AS s FROM c WHERE file_path <> '' AND coalesce(t, '') <> '')
 SELECT row_id, step_pos, call_pos, file_path, s::INT AS start_line, (s + n - 1)::INT AS end_line, left(t, 5000) AS text FROM k""",
    "dataset_records": """SELECT 'own/set:default:0123456789ab:' || row_id AS session_id, task.description AS task, outcome.success AS success, CASE WHEN outcome.success IS NOT NULL THEN 'source_metadata' END AS signal_source,
 CASE outcome.success WHEN true THEN 'goal_reached' WHEN false THEN 'abandoned' END AS terminal_state FROM traces WHERE len(list_filter(steps, lambda s: coalesce(s.role, '') <> 'system')) > 0""",
    "trace_exported": "SELECT coalesce(session_id, trace_id) AS session_id, coalesce(agent.name, 'unknown') AS agent, len(steps)::BIGINT AS n_steps, metrics.total_input_tokens AS tokens, list_sum(list_transform(steps, lambda s: coalesce(len(s.tool_calls), 0)))::BIGINT AS n_calls FROM traces WHERE len(steps) > 0",
    "exchange_coverage": "SELECT * FROM (VALUES " + ", ".join(f"('{p}', '{k}')" for p, k in shards.COVERAGE) + ") t(path, kept)",
    "trace_detail": "SELECT row_id, (i - 1)::INT AS pos, s.role AS role, CASE WHEN length(s.content) > 500 THEN left(s.content, 500) || '... (truncated)' ELSE s.content END AS content, coalesce(len(s.tool_calls), 0)::INT AS n_calls FROM (SELECT row_id, unnest(steps) AS s, unnest(range(1, len(steps) + 1)) AS i FROM traces WHERE row_id IN (3, 5, 8, 13))",
    "trace_judge_summary": """WITH n AS (SELECT *, flatten(list_filter(list_transform(steps, lambda s: list_transform(s.tool_calls, lambda c: c.tool_name)), lambda x: x IS NOT NULL)) AS names FROM traces)
 SELECT row_id, left(task.description, 500) AS task, coalesce(len(list_filter(steps, lambda s: s.role = 'user')), 0)::INT AS n_user, coalesce(len(list_filter(steps, lambda s: s.role = 'agent')), 0)::INT AS n_agent, coalesce(len(names), 0)::INT AS n_calls,
 array_to_string(list_sort(list_distinct(names))[1:5], ',') AS tools, array_to_string(list_sort(list_distinct(dependencies))[1:20], ',') AS packages, array_to_string(list_sort(list_distinct(list_filter(list_transform(attribution.files, lambda f: f.path), lambda p: p IS NOT NULL)))[1:10], ',') AS files FROM n""",
    "trace_unattributed": """SELECT row_id, array_to_string(list_sort(list_filter(list_distinct(regexp_extract_all(coalesce(environment.vcs.diff, ''), '(?m)^[+]{3} b/([^\r\n\t]+)', 1)),
 lambda p: NOT coalesce(list_contains(list_transform(attribution.files, lambda f: f.path), p), false))), ',') AS files FROM traces""",
    "series_totals": "SELECT event_type AS metric, round_even(sum(value), 2) AS total, round_even(sum(value) FILTER (ts > (SELECT max(ts) FROM events) - INTERVAL 365 DAY), 2) AS recent, count(DISTINCT strftime(ts, '%Y-%m-%d')) AS n_days FROM events GROUP BY ALL",
    "series_projects": "SELECT user_id AS project, count(*) AS n FROM events GROUP BY ALL",
    "state_by_stage": """WITH l AS (SELECT trace_id, lower(trim(status)) AS status FROM trace_state QUALIFY row_number() OVER (PARTITION BY trace_id ORDER BY created_at DESC NULLS LAST, lower(trim(status)) DESC NULLS LAST, uploaded_at DESC NULLS LAST, error DESC NULLS LAST) = 1)
 SELECT *, coalesce(list_position(['inbox', 'committed', 'pushed', 'uploaded', 'rejected', 'failed'], status), 7)::INT AS place FROM (SELECT coalesce(status, 'inbox') AS status, count(*) AS n FROM (SELECT DISTINCT trace_id FROM traces WHERE trace_id IS NOT NULL) LEFT JOIN l USING (trace_id) GROUP BY ALL)""",
    "card_repositories": "SELECT coalesce(task.repository, 'unknown') AS repository, count(*) AS n FROM traces GROUP BY ALL",
    "filter_tagged": "SELECT row_id FROM traces WHERE coalesce(list_contains(list_transform(dependencies, lambda x: lower(x)), 'kestrel'), false) OR coalesce(contains(lower(task.repository), 'kestrel'), false)",
    "batch_groups": "SELECT batch_no, count(DISTINCT trace_id) AS n_traces, min(row_id) AS first_row, max(row_id) AS last_row FROM traces GROUP BY ALL",
    "union_documents": "SELECT doc_id, source, max(v) AS version FROM (SELECT doc_id, source, n_chars AS v FROM documents WHERE doc_id % 3 <> 0 UNION ALL SELECT doc_id, source, n_chars + 1 FROM documents WHERE doc_id % 3 <> 1) GROUP BY ALL",
}
