"""Schema population audit: how often each field of the catalogue is filled, and why not.

Rates of all fields come from one pass: every field is an expression that gives
(filled, total) for one record, summed with partial aggregation; the result has
one row per field of the catalogue (a small dimension table).

Defined results: 0 and false are filled, blank texts and empty arrays are not; a
field of an array counts its elements (an empty array adds nothing); a field that
the catalogue names but the engine does not know has no rate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.functions.dialect import SPARK, Dialect

# Fields that no source fills yet, and fields that depend on the session.
NOT_YET = ("task.repository", "task.base_commit", "security.classifier_version")
BY_SESSION = ("steps[].snippets", "attribution.files", "dependencies", "outcome.commit_sha", "outcome.patch", "environment.vcs.diff", "environment.vcs.branch", "steps[].parent_step", "steps[].subagent_trajectory_ref")


def measures(d: Dialect) -> dict[str, tuple[str, str]]:
    """Path -> (filled, total) of one record."""
    text = lambda x: f"(CASE WHEN coalesce(trim({x}), '') <> '' THEN 1 ELSE 0 END)"
    some = lambda x: f"(CASE WHEN {x} IS NOT NULL THEN 1 ELSE 0 END)"
    many = lambda x: f"(CASE WHEN {d.size(x)} > 0 THEN 1 ELSE 0 END)"
    calls = d.flat("steps", "s", "s.tool_calls", "struct<tool_call_id:string,tool_name:string,input:string,duration_ms:bigint>")
    step_text = lambda f: (d.count("steps", "s", f"coalesce(trim(s.{f}), '') <> ''"), d.size("steps"))
    step_some = lambda f: (d.count("steps", "s", f"s.{f} IS NOT NULL"), d.size("steps"))
    out = {p: (text(p), "1") for p in ("task.description", "task.repository", "task.source", "agent.name", "agent.version", "agent.model", "environment.os", "environment.shell", "environment.vcs.diff", "environment.vcs.branch", "security.classifier_version", "content_hash", "execution_context")}
    out |= {p: (some(p), "1") for p in ("outcome.success", "metrics.cache_hit_rate", "metrics.total_duration_s", "metrics.estimated_cost_usd")}
    out |= {p: (many(p), "1") for p in ("dependencies", "attribution.files", "environment.language_ecosystem", "tool_definitions")}
    out |= {f"steps[].{f}": step_text(f) for f in ("role", "call_type", "model", "system_prompt_hash", "timestamp", "content", "reasoning_content")}
    out |= {f"steps[].{f}": step_some(f) for f in ("token_usage.input_tokens", "token_usage.output_tokens", "token_usage.cache_read_tokens", "parent_step")}
    out["steps[].tool_calls[].tool_name"] = (d.count(calls, "c", "coalesce(trim(c.tool_name), '') <> ''"), d.size(calls))
    out["steps[].tool_calls[].duration_ms"] = (d.count(calls, "c", "c.duration_ms IS NOT NULL"), d.size(calls))
    return out


def population(traces: DataFrame) -> DataFrame:
    """(path, populated_count, total_count, population_rate); no rows for an empty table."""
    m = measures(SPARK)
    sums = traces.selectExpr(*[f"CAST({e} AS bigint) AS {k}{i}" for i, (f, t) in enumerate(m.values()) for k, e in (("f", f), ("t", t))]).agg(F.count(F.lit(1)).alias("rows"), *[F.sum(f"{k}{i}").alias(f"{k}{i}") for i in range(len(m)) for k in "ft"])
    rows = F.array(*[F.struct(F.lit(p).alias("path"), F.col(f"f{i}").alias("populated_count"), F.col(f"t{i}").alias("total_count")) for i, p in enumerate(m)])
    out = sums.where(F.col("rows") > 0).select(F.inline(rows))
    return out.withColumn("population_rate", F.when(F.col("total_count") > 0, F.bround(F.col("populated_count") / F.col("total_count"), 4)).otherwise(0.0))


def classify(rate: Column, path: Column, source: Column, expected: Column) -> Column:
    """The kind of gap of a field, by its rate, source and when it is expected."""
    always = F.coalesce(expected, F.lit("always")) == "always"
    return (
        F.when(rate >= 0.8, "ok")
        .when(path.isin(*NOT_YET), "not_yet_implemented")
        .when(path.isin(*BY_SESSION) & F.coalesce(expected, F.lit("")).isin("optional", "has_edits", "has_commits", "has_subagents"), "session_dependent")
        .when(F.coalesce(source, F.lit("")).startswith("enrichment:") & (rate < 0.5), F.when(always, "enrichment_gap").otherwise("session_dependent"))
        .when((source == "parser") & always & (rate < 0.5), "needs_review")
        .when(~always & (rate < 0.5), "session_dependent")
        .otherwise("needs_review")
    )


def audit(traces: DataFrame, specs: DataFrame) -> DataFrame:
    """The catalogue with rates and gap kinds."""
    j = specs.select("path", "source", "expected_when", "persona_impact").join(population(traces), "path")
    return j.withColumn("classification", classify(F.col("population_rate"), F.col("path"), F.col("source"), F.col("expected_when")))


def gaps(audited: DataFrame) -> DataFrame:
    """Gaps per persona that they touch and kind."""
    return audited.where(F.col("classification") != "ok").select(F.explode("persona_impact").alias("persona"), "classification").groupBy("persona", "classification").agg(F.count(F.lit(1)).alias("n"))
