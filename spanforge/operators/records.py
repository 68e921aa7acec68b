"""Projections and per-record measures of nested traces; no operator here shuffles.

Each is a set of expressions over one record, stated for both dialects.
Null or absent arrays and structs count as empty, unparsable times as null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from spanforge.functions.dialect import Dialect

_CALL = "struct<tool_call_id:string,tool_name:string,input:string,duration_ms:bigint>"
_OBS = "struct<source_call_id:string,content:string,output_summary:string,error:string>"


def all_calls(d: Dialect) -> str:
    return d.flat("steps", "s", "s.tool_calls", _CALL)


def all_observations(d: Dialect) -> str:
    return d.flat("steps", "s", "s.observations", _OBS)


def token_metrics(d: Dialect) -> dict[str, str]:
    """Tokens, cache hit rate, duration and step count of a session."""
    tok = lambda k: d.sum("coalesce(steps, " + ("array()" if d.spark else "[]") + ")", "s", f"s.token_usage.{k}")
    times = d.filter(d.map("steps", "s", d.time("s.timestamp")), "x", "x IS NOT NULL")
    cached, fresh = tok("cache_read_tokens"), tok("input_tokens")
    return {
        "n_steps": d.size("steps"),
        "input_tokens": fresh,
        "output_tokens": tok("output_tokens"),
        "cache_read_tokens": cached,
        "cache_hit_rate": f"CASE WHEN {cached} + {fresh} > 0 THEN {d.round(f'CAST({cached} AS double) / ({cached} + {fresh})', 4)} END",
        "duration_s": f"CASE WHEN {d.max(times)} > {d.min(times)} THEN {d.round(f'({d.max(times)} - {d.min(times)}) / CAST(1000000 AS double)', 2)} END",
    }


def list_view(d: Dialect) -> dict[str, str]:
    """A row of a session list: cut task, agent, model, counts."""
    desc = "trim(coalesce(task.description, ''))"
    models = d.sort(d.distinct(d.filter(d.map("steps", "s", "coalesce(s.model, '')"), "x", "x <> ''")))
    step_models = d.join(models, ", ")
    return {
        "task": f"CASE WHEN {desc} = '' THEN 'untitled' ELSE left({desc}, 60) END",
        "agent": "coalesce(agent.name, 'unknown')",
        "model": f"coalesce(agent.model, CASE WHEN coalesce({step_models}, '') <> '' THEN {step_models} END, 'unknown')",
        "step_count": d.size("steps"),
        "tool_count": d.size(all_calls(d)),
        "flag_count": "coalesce(security.flags_reviewed, 0)",
    }


def linkage(d: Dialect) -> dict[str, str]:
    """Calls without observation and observations without call, by distinct ids; unresolved prompt keys."""
    calls = d.distinct(d.filter(d.map(all_calls(d), "c", "coalesce(c.tool_call_id, '')"), "x", "x <> ''"))
    seen = d.distinct(d.filter(d.map(all_observations(d), "o", "coalesce(o.source_call_id, '')"), "x", "x <> ''"))
    refs = f"coalesce({d.distinct(d.filter(d.map('steps', 's', 'coalesce(s.system_prompt_hash, ' + chr(39) * 2 + ')'), 'x', 'x <> ' + chr(39) * 2))}, {d.empty()})"
    keys = f"coalesce({d.keys('system_prompts')}, {d.empty()})"
    return {"n_calls": d.size(calls), "n_observations": d.size(seen), "unanswered": d.size(d.except_(calls, seen)), "dangling": d.size(d.except_(seen, calls)), "unresolved_prompts": d.size(d.except_(refs, keys))}


def quality_filter(d: Dialect) -> str:
    """At least two steps and a tool call."""
    return f"{d.size('steps')} >= 2 AND {d.size(all_calls(d))} >= 1"


def renumbered(d: Dialect) -> str:
    """Steps numbered 1..n in order, parents following (the last step of a repeated old index)."""
    idx = d.map("steps", "s", "coalesce(s.step_index, -1)")
    last = lambda x: d.max(d.filter(d.range(d.size("steps")), "j", f"{d.at(idx, 'j')} = {x}"))
    el = d.at("steps", "i")
    return d.map(d.range(d.size("steps")), "i", d.struct(new_index="CAST(i + 1 AS bigint)", old_index=f"{el}.step_index", new_parent=f"CAST({last(el + '.parent_step')} + 1 AS bigint)", role=f"{el}.role"))


def redacted_step(d: Dialect, at: str = "0") -> str:
    """Steps with the content of one position withheld."""
    el = d.at("steps", "i")
    return d.map(
        d.range(d.size("steps")),
        "i",
        d.struct(pos="CAST(i AS bigint)", content=f"CASE WHEN i = {at} THEN '[REDACTED]' ELSE {el}.content END", reasoning=f"CASE WHEN i = {at} THEN NULL ELSE {el}.reasoning_content END", n_calls=f"CASE WHEN i = {at} THEN 0 ELSE {d.size(el + '.tool_calls')} END"),
    )


def signal_kept(d: Dialect) -> str:
    """Share of fields (steps, calls, observations) that a redaction of the flagged calls would leave."""
    total = f"({d.size('steps')} + {d.size(all_calls(d))} + {d.size(all_observations(d))})"
    hit = d.count(all_observations(d), "o", "coalesce(o.error, '') <> ''")
    return d.round(f"1.0 - CAST({hit} AS double) / greatest({total}, 1)", 2)


def exchange_steps(d: Dialect) -> str:
    """Steps in the agent-trajectory exchange form: renumbered, renamed, errors in brackets."""
    el = d.at("steps", "i")
    obs = d.map(f"coalesce({el}.observations, {d.empty(_OBS)})", "o", d.struct(source_call_id="o.source_call_id", content="coalesce('[error: ' || o.error || ']', o.content)"))
    calls = d.map(f"coalesce({el}.tool_calls, {d.empty(_CALL)})", "c", d.struct(tool_call_id="c.tool_call_id", function_name="c.tool_name", arguments="c.input"))
    return d.map(
        d.range(d.size("steps")),
        "i",
        d.struct(
            step_id="CAST(i + 1 AS bigint)", source=f"{el}.role", message=f"coalesce({el}.content, '')", reasoning=f"{el}.reasoning_content", model_name=f"{el}.model",
            tool_calls=calls, results=obs,
            prompt_tokens=f"CASE WHEN coalesce({el}.token_usage.input_tokens, 0) + coalesce({el}.token_usage.output_tokens, 0) > 0 THEN {el}.token_usage.input_tokens END",
            completion_tokens=f"CASE WHEN coalesce({el}.token_usage.input_tokens, 0) + coalesce({el}.token_usage.output_tokens, 0) > 0 THEN {el}.token_usage.output_tokens END",
        ),
    )


def context_sources(d: Dialect) -> dict[str, str]:
    """Nodes and tokens by where their text comes from; a step with tools counts once for each of its nodes."""
    tokens = "(coalesce(s.token_usage.input_tokens, 0) + coalesce(s.token_usage.output_tokens, 0))"
    project = "('Read', 'Grep', 'Glob', 'Edit', 'Write')"
    none = "array()" if d.spark else "[]"
    steps = f"coalesce(steps, {none})"
    in_project = d.count("s.tool_calls", "c", f"c.tool_name IN {project}")
    outside = d.count("s.tool_calls", "c", f"coalesce(c.tool_name, '') NOT IN {project}")
    return {
        "user_nodes": d.count("steps", "s", "s.role = 'user'"),
        "llm_nodes": d.count("steps", "s", "s.role = 'agent'"),
        "project_nodes": d.sum(steps, "s", in_project),
        "external_nodes": d.sum(steps, "s", outside),
        "user_tokens": d.sum(steps, "s", f"CASE WHEN s.role = 'user' THEN {tokens} ELSE 0 END"),
        "llm_tokens": d.sum(steps, "s", f"CASE WHEN s.role = 'agent' THEN {tokens} ELSE 0 END"),
        "project_tokens": d.sum(steps, "s", f"{in_project} * {tokens}"),
        "external_tokens": d.sum(steps, "s", f"{outside} * {tokens}"),
    }


def representative_steps(d: Dialect) -> str:
    """Positions of the telling steps: first, most tools with reasoning, most tools, first error, last; at most five, in order."""
    n = d.size("steps")
    pos = d.range(n)
    el = d.at("steps", "i")
    tools = d.map("steps", "s", d.size("s.tool_calls"))
    both = d.map("steps", "s", f"CASE WHEN coalesce(s.reasoning_content, '') <> '' THEN {d.size('s.tool_calls')} ELSE 0 END")
    first_of = lambda values: d.min(d.filter(pos, "i", f"{d.at(values, 'i')} = {d.max(values)} AND {d.at(values, 'i')} > 0"))
    bad = d.min(d.filter(pos, "i", f"{d.count(f'{el}.observations', 'o', 'coalesce(o.error, ' + chr(39) * 2 + ') <> ' + chr(39) * 2)} > 0"))
    picks = f"array(CASE WHEN {n} > 0 THEN 0 END, {first_of(both)}, {first_of(tools)}, {bad}, CASE WHEN {n} > 0 THEN {n} - 1 END)"
    if not d.spark:
        picks = picks.replace("array(", "[", 1)[:-1] + "]"
    return d.sort(d.distinct(d.filter(picks, "x", "x IS NOT NULL")))


def project(traces: DataFrame, cols: dict[str, str], keys: tuple[str, ...] = ("row_id",)) -> DataFrame:
    return traces.selectExpr(*keys, *[f"{x} AS {n}" for n, x in cols.items()])


def exploded(traces: DataFrame, structs: str) -> DataFrame:
    return traces.selectExpr("row_id", f"inline({structs})")
