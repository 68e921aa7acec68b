"""Queries of the audit and of the display projections."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.functions.dialect import DUCK, SPARK
from spanforge.operators import audit, enrich, records, views
from spanforge.sources.tables import pick, table

Query = Callable[[SparkSession, str], DataFrame]

WEIGHTS = [("d1", 0.3), ("d2", 0.25), ("d3", 0.2), ("d4", 0.15), ("d5", 0.1)]


def _ratings(s: SparkSession, d: str) -> DataFrame:
    li = table(s, d, "lineitem")
    return li.select(F.col("l_orderkey").alias("record"), F.col("l_returnflag").alias("persona"), F.concat(F.lit("d"), F.col("l_linenumber").cast("string")).alias("dimension"), (F.col("l_quantity") % 7).cast("int").alias("score"))


def consumer(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "traces", "row_id bigint, execution_context string, outcome struct<success:boolean>, task struct<repository:string>, agent struct<name:string, model:string>")
    return views.consumer_filter(t, ["kestrel/atlas"], model_part="LOOM").select("row_id")


_FIELDS = (
    "task agent environment.os environment.shell environment.vcs environment.language_ecosystem security.classifier_version content_hash execution_context outcome.success metrics dependencies attribution.files.path "
    "tool_definitions steps.role steps.call_type steps.model steps.system_prompt_hash steps.timestamp steps.content steps.reasoning_content steps.token_usage steps.parent_step steps.tool_calls.tool_name steps.tool_calls.duration_ms"
)


def _audited(s: SparkSession, d: str) -> DataFrame:
    return pick(s, d, "traces", _FIELDS)


QUERIES: dict[str, Query] = {
    "audit_population": lambda s, d: audit.population(_audited(s, d)),
    "audit_gaps": lambda s, d: audit.audit(_audited(s, d), table(s, d, "field_specs")).select("path", "population_rate", "classification"),
    "audit_by_persona": lambda s, d: audit.gaps(audit.audit(_audited(s, d), table(s, d, "field_specs"))),
    "view_sessions": lambda s, d: records.project(pick(s, d, "traces", "row_id task.description agent.model metrics"), views.session_view(SPARK)),
    "view_calls": lambda s, d: enrich.calls(pick(s, d, "traces", "row_id steps.tool_calls steps.observations"), f"{views.primary_argument(SPARK, 'tool_name', 'input')} AS argument"),
    "view_documents": lambda s, d: table(s, d, "documents").selectExpr("doc_id", f"{views.clean(SPARK, 'text')} AS cleaned", f"{views.first_line(SPARK, 'text')} AS title"),
    "filter_consumer": consumer,
    "rollup_orders": lambda s, d: views.cross_rollup(table(s, d, "orders").withColumn("m", F.when(F.col("o_orderstatus") != "P", F.length("o_orderpriority").cast("double"))), "o_orderpriority", "o_totalprice", "m", "o_custkey").select(
        "o_orderpriority", F.bround("size", 2).alias("size"), "weighted_mean", "n_distinct"
    ),
    "card_sizes": lambda s, d: table(s, d, "traces", "task struct<repository:string>").groupBy(F.col("task.repository").alias("repository")).agg(F.count(F.lit(1)).alias("n")).selectExpr("repository", "n", f"{views.size_bucket('n')} AS size"),
    "batch_messages": lambda s, d: views.messages(table(s, d, "traces", "row_id bigint, batch_no bigint, task struct<description:string>")),
    "judge_overall": lambda s, d: views.judge_overall(_ratings(s, d), s.createDataFrame(WEIGHTS, "dimension string, weight double")),
}

_M = audit.measures(DUCK)
_POP = "SELECT path, f AS populated_count, t AS total_count, CASE WHEN t > 0 THEN round_even(f / t, 4) ELSE 0.0 END AS population_rate FROM (" + " UNION ALL ".join(f"SELECT '{p}' AS path, sum({f})::BIGINT AS f, sum({t})::BIGINT AS t FROM traces" for p, (f, t) in _M.items()) + ") WHERE t IS NOT NULL"
_GAPS = f"""SELECT path, population_rate, persona_impact, CASE WHEN population_rate >= 0.8 THEN 'ok' WHEN path IN {audit.NOT_YET} THEN 'not_yet_implemented'
 WHEN path IN {audit.BY_SESSION} AND coalesce(expected_when, '') IN ('optional', 'has_edits', 'has_commits', 'has_subagents') THEN 'session_dependent'
 WHEN source LIKE 'enrichment:%' AND population_rate < 0.5 THEN CASE WHEN coalesce(expected_when, 'always') = 'always' THEN 'enrichment_gap' ELSE 'session_dependent' END
 WHEN source = 'parser' AND coalesce(expected_when, 'always') = 'always' AND population_rate < 0.5 THEN 'needs_review'
 WHEN coalesce(expected_when, 'always') <> 'always' AND population_rate < 0.5 THEN 'session_dependent' ELSE 'needs_review' END AS classification FROM field_specs JOIN ({_POP}) USING (path)"""
_W = ", ".join(f"('{k}', {v})" for k, v in WEIGHTS)
ORACLE: dict[str, str] = {
    "audit_population": _POP,
    "audit_gaps": f"SELECT path, population_rate, classification FROM ({_GAPS})",
    "audit_by_persona": f"SELECT persona, classification, count(*) AS n FROM (SELECT unnest(persona_impact) AS persona, classification FROM ({_GAPS}) WHERE classification <> 'ok') GROUP BY ALL",
    "view_sessions": "SELECT row_id, " + ", ".join(f"{e} AS {n}" for n, e in views.session_view(DUCK).items()) + " FROM traces",
    "view_calls": f"SELECT row_id, u.step_pos, u.call_pos, {views.primary_argument(DUCK, 'u.tool_name', 'u.input')} AS argument FROM (SELECT row_id, unnest({enrich.flat_calls(DUCK)}) AS u FROM traces)",
    "view_documents": f"SELECT doc_id, {views.clean(DUCK, 'text')} AS cleaned, {views.first_line(DUCK, 'text')} AS title FROM documents",
    "filter_consumer": "SELECT row_id FROM traces WHERE outcome.success AND execution_context = 'devtime' AND NOT coalesce(task.repository IN ('kestrel/atlas'), false) AND contains(lower(agent.model), 'loom')",
    "rollup_orders": """SELECT o_orderpriority, round_even(sum(o_totalprice), 2) AS size, round_even(sum(m * o_totalprice) / nullif(sum(o_totalprice) FILTER (m IS NOT NULL), 0), 4) AS weighted_mean, count(DISTINCT o_custkey) AS n_distinct
 FROM (SELECT *, CASE WHEN o_orderstatus <> 'P' THEN length(o_orderpriority)::DOUBLE END AS m FROM orders) GROUP BY ALL""",
    "card_sizes": f"SELECT repository, n, {views.size_bucket('n')} AS size FROM (SELECT task.repository AS repository, count(*) AS n FROM traces GROUP BY ALL)",
    "batch_messages": """SELECT batch_no, CASE WHEN max(n) > 3 THEN string_agg(x, '; ' ORDER BY row_id) || ' (+' || (max(n) - 3) || ' more)' ELSE string_agg(x, '; ' ORDER BY row_id) END AS message FROM (
 SELECT batch_no, row_id, left(task.description, 40) AS x, count(*) OVER (PARTITION BY batch_no) AS n, row_number() OVER (PARTITION BY batch_no ORDER BY row_id) AS r FROM traces WHERE coalesce(trim(task.description), '') <> '') WHERE r <= 3 GROUP BY ALL""",
    "judge_overall": f"""WITH w(dimension, weight) AS (VALUES {_W}), r AS (SELECT l_orderkey AS record, l_returnflag AS persona, 'd' || l_linenumber AS dimension, max((l_quantity % 7)::INT) AS score FROM lineitem GROUP BY ALL)
 SELECT k.record, k.persona, round_even(sum((least(greatest(coalesce(r.score, 3), 1), 5) - 1) / 4 * 100 * weight) / sum(weight), 1) AS overall FROM (SELECT DISTINCT record, persona FROM r) k CROSS JOIN w LEFT JOIN r USING (record, persona, dimension) GROUP BY ALL""",
}
