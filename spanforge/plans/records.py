"""Queries of the per-record operators and of the quality assessment."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from spanforge.functions.dialect import DUCK, SPARK
from spanforge.operators import quality, records
from spanforge.sources.tables import pick

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def _columns(name: str, paths: str, f) -> None:
    QUERIES[name] = lambda s, d: records.project(pick(s, d, "traces", f"row_id {paths}"), f(SPARK))
    ORACLE[name] = "SELECT row_id, " + ", ".join(f"{x} AS {n}" for n, x in f(DUCK).items()) + " FROM traces"


def _rows(name: str, paths: str, f) -> None:
    QUERIES[name] = lambda s, d: records.exploded(pick(s, d, "traces", f"row_id {paths}"), f(SPARK))
    ORACLE[name] = f"SELECT row_id, u.* FROM (SELECT row_id, unnest({f(DUCK)}) AS u FROM traces)"


_IDS = "steps.tool_calls.tool_call_id steps.observations.source_call_id"
_columns("trace_metrics", "steps.token_usage steps.timestamp", records.token_metrics)
_columns("trace_list", "task.description agent steps.model steps.tool_calls.tool_name security.flags_reviewed", records.list_view)
_columns("trace_linkage", f"{_IDS} steps.system_prompt_hash system_prompts", records.linkage)
_columns("trace_context_sources", "steps.role steps.token_usage steps.tool_calls.tool_name", records.context_sources)
_columns("trace_signal_kept", "steps.tool_calls.tool_call_id steps.observations.error", lambda d: {"signal_kept": records.signal_kept(d)})
_columns("trace_quality_filter", "steps.tool_calls.tool_call_id", lambda d: {"meets": records.quality_filter(d)})
_rows("trace_renumbered", "steps.step_index steps.parent_step steps.role", records.renumbered)
_rows("trace_redacted_step", "steps.content steps.reasoning_content steps.tool_calls.tool_call_id", records.redacted_step)
_rows("trace_representative_steps", "steps.reasoning_content steps.tool_calls.tool_call_id steps.observations.error", lambda d: d.map(records.representative_steps(d), "x", d.struct(pos="CAST(x AS bigint)")))


def trace_exchange(spark: SparkSession, d: str) -> DataFrame:
    return records.exploded(pick(spark, d, "traces", "row_id steps.role steps.content steps.reasoning_content steps.model steps.tool_calls steps.observations steps.token_usage"), records.exchange_steps(SPARK)).selectExpr(
        "row_id", "step_id", "source", "message", "reasoning", "model_name", "transform(tool_calls, c -> c.function_name) AS functions", "transform(results, r -> r.content) AS results", "prompt_tokens", "completion_tokens"
    )


QUERIES["trace_exchange"] = trace_exchange
ORACLE["trace_exchange"] = (
    "SELECT row_id, u.step_id, u.source, u.message, u.reasoning, u.model_name, list_transform(u.tool_calls, lambda c: c.function_name) AS functions, list_transform(u.results, lambda r: r.content) AS results,"
    f" u.prompt_tokens, u.completion_tokens FROM (SELECT row_id, unnest({records.exchange_steps(DUCK)}) AS u FROM traces)"
)

_R = quality.oracle_results()
_P = f"""SELECT row_id, persona, coalesce(round_even(sum(weight * score) FILTER (NOT skipped) / sum(weight) FILTER (NOT skipped) * 100, 1), 0.0) AS total_score,
 coalesce(round_even(avg(passed::INT) FILTER (NOT skipped), 3), 0.0) AS pass_rate, bool_and(skipped) AS skipped FROM ({_R}) GROUP BY ALL"""
_S = f"SELECT persona, count(*) FILTER (NOT skipped) AS n_scored, min(total_score) FILTER (NOT skipped) AS min_score, max(total_score) FILTER (NOT skipped) AS max_score, round_even(avg(total_score) FILTER (NOT skipped), 1) AS avg_score FROM ({_P}) GROUP BY ALL"

#: a table of bounds for the gate query: persona, least single score, least mean
BOUNDS = [("conformance", 70.0, 80.0), ("training", 40.0, 45.0), ("rl", None, 40.0), ("analytics", 60.0, 70.0), ("domain", 45.0, 55.0)]


#: what the checks look at; texts are read for the check that no secret is left in them
_CHECKED = (
    "row_id schema_version trace_id content_hash timestamp_start timestamp_end execution_context task.description agent.name agent.version environment.os environment.vcs environment.language_ecosystem "
    "system_prompts steps.step_index steps.role steps.content steps.reasoning_content steps.model steps.system_prompt_hash steps.parent_step steps.call_type steps.tool_calls steps.observations "
    "steps.snippets.language steps.token_usage steps.timestamp outcome dependencies metrics security attribution.files.path metadata"
)


def _traces(s: SparkSession, d: str) -> DataFrame:
    return pick(s, d, "traces", _CHECKED)


def _results(s: SparkSession, d: str) -> DataFrame:
    return quality.check_results(_traces(s, d))


def _scores(s: SparkSession, d: str) -> DataFrame:
    return quality.trace_scores(_traces(s, d))


def quality_gate(s: SparkSession, d: str) -> DataFrame:
    return quality.gate(quality.batch_summary(_scores(s, d)), s.createDataFrame(BOUNDS, "persona string, min_individual double, min_average double"))


QUERIES |= {
    "quality_checks": _results,
    "quality_scores": _scores,
    "quality_utility": lambda s, d: quality.trace_utilities(_traces(s, d)),
    "quality_summary": lambda s, d: quality.batch_summary(_scores(s, d)),
    "quality_breakdown": lambda s, d: quality.breakdown(_results(s, d)),
    "quality_categories": lambda s, d: quality.category_scores(_results(s, d)),
    "quality_gate": quality_gate,
}
_B = ", ".join(f"('{p}', {'NULL' if a is None else a}, {b})" for p, a, b in BOUNDS)
ORACLE |= {
    "quality_checks": _R,
    "quality_scores": _P,
    "quality_utility": f"SELECT row_id, round_even(avg(total_score) FILTER (NOT skipped), 1) AS overall_utility FROM ({_P}) GROUP BY ALL",
    "quality_summary": _S,
    "quality_breakdown": f"""SELECT *, CASE WHEN avg_score >= 90 THEN 'ok' WHEN avg_score >= 50 THEN 'WARN' ELSE 'CRITICAL' END AS status FROM (SELECT persona, check_name, count(*) FILTER (NOT skipped) AS n,
 round_even(avg(score) FILTER (NOT skipped) * 100, 1) AS avg_score, round_even(avg(passed::INT) FILTER (NOT skipped) * 100, 1) AS pass_rate FROM ({_R}) GROUP BY ALL)""",
    "quality_categories": f"SELECT persona, category, round_even(sum(weight * score) FILTER (NOT skipped) / sum(weight) FILTER (NOT skipped) * 100, 1) AS score FROM ({_R}) GROUP BY ALL",
    "quality_gate": f"""SELECT s.persona, min_score, avg_score, coalesce(min_score < lo, false) AS individual_failed, coalesce(avg_score < av, false) AS average_failed,
 NOT coalesce(min_score < lo, false) AND NOT coalesce(avg_score < av, false) AS passed FROM ({_S}) s LEFT JOIN (VALUES {_B}) b(persona, lo, av) USING (persona)""",
}
