"""Quality checks, persona scores, batch summaries and gates.

A check is a triple of expressions (skipped, passed, score) over the features of
a trace.  Features are one projection over the nested record and all checks
another, so the whole assessment of a trace is computed where it is read; only
the aggregation over traces is shuffled, pre-aggregated per persona and check.

Defined results: null or absent steps count as no steps, a null step as a step
without fields; a check that cannot apply is skipped and drops out of weights.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.functions.dialect import DUCK, SPARK, Dialect

SCHEMA_VERSION = "0.2.0"
# Tools that change files.
WRITE_TOOLS = ("Edit", "Write", "MultiEdit", "NotebookEdit")


class Check(NamedTuple):
    name: str
    persona: str
    category: str
    weight: float
    skipped: str
    passed: str
    score: str


def features(d: Dialect) -> dict[str, str]:
    """Name -> expression over a trace record ``t``."""
    call, obs = "struct<tool_call_id:string,tool_name:string,input:string,duration_ms:bigint>", "struct<source_call_id:string,content:string,output_summary:string,error:string>"
    snip = "struct<file_path:string,start_line:bigint,end_line:bigint,language:string,text:string,source_step:bigint>"
    s, agents = "steps", d.filter("steps", "s", "s.role = 'agent'")
    filled = lambda x: f"(coalesce(trim({x}), '') <> '')"
    tok = lambda k: f"coalesce(s.token_usage.{k}, 0)"
    calls, seen, snips = (d.flat(s, "s", f"s.{f}", k) for f, k in (("tool_calls", call), ("observations", obs), ("snippets", snip)))
    idx = d.map(s, "s", "coalesce(s.step_index, -1)")
    turns = lambda cond: d.map(d.filter(s, "s", cond), "s", "coalesce(s.role, '')")
    plain = turns("coalesce(s.role, '') <> 'system' AND coalesce(s.call_type, '') <> 'subagent'")
    call_ids = d.distinct(d.filter(d.map(calls, "c", "coalesce(c.tool_call_id, '')"), "x", "x <> ''"))
    obs_ids = d.distinct(d.filter(d.map(seen, "o", "coalesce(o.source_call_id, '')"), "x", "x <> ''"))
    with_tools = d.filter(agents, "s", f"{d.size('s.tool_calls')} > 0")
    at = lambda kind: d.map(d.filter(d.range(d.size(s)), "i", f"{d.at('steps', 'i')}.call_type {kind}"), "i", "i")
    refs = d.distinct(d.filter(d.map(s, "s", "coalesce(s.system_prompt_hash, '')"), "x", "x <> ''"))
    prompts = d.keys("system_prompts") if d.spark else "map_keys(system_prompts)"
    texts = d.join(
        d.map(s, "s", f"concat_ws(' ', s.content, s.reasoning_content, {d.join(d.map('s.tool_calls', 'c', chr(99) + '.input'), ' ')}, {d.join(d.map('s.observations', 'o', chr(111) + '.content'), ' ')})"), " "
    )
    return {
        "version": "coalesce(schema_version, '')",
        "id": "coalesce(trace_id, '')",
        "hash_len": "length(coalesce(content_hash, ''))",
        "agent_name": "trim(coalesce(agent.name, ''))",
        "agent_version": "trim(coalesce(agent.version, ''))",
        "has_start": "timestamp_start IS NOT NULL",
        "has_end": "timestamp_end IS NOT NULL",
        "rt": "coalesce(execution_context, '') = 'runtime'",
        "conv": f"coalesce({d.json('metadata', 'step_fidelity')}, '') = 'conversation_turn'",
        "task_len": "length(trim(coalesce(task.description, '')))",
        "os": filled("environment.os"),
        "vcs": "coalesce(environment.vcs.type, '')",
        "branch": filled("environment.vcs.branch"),
        "n_lang": d.size("environment.language_ecosystem"),
        "n_deps": d.size("dependencies"),
        "n_refs": d.size(refs),
        "n_prompts": d.size(prompts) if d.spark else f"coalesce(len({prompts}), 0)",
        "bad_refs": d.size(d.except_(refs, f"coalesce({prompts}, {d.empty()})")),
        "n_steps": d.size(s),
        "n_agent": d.size(agents),
        "bad_roles": d.count(s, "s", "coalesce(s.role, '') NOT IN ('user', 'agent', 'system')"),
        "idx_distinct": d.size(d.distinct(idx)),
        "idx_falls": d.count(d.range(f"{d.size(s)} - 1"), "i", f"{d.at(idx, 'i')} > {d.at(idx, 'i + 1')}"),
        "n_calls": d.size(calls),
        "n_call_ids": d.count(calls, "c", "coalesce(c.tool_call_id, '') <> ''"),
        "n_obs": d.size(seen),
        "n_obs_ids": d.count(seen, "o", "coalesce(o.source_call_id, '') <> ''"),
        "k_calls": d.size(call_ids),
        "k_obs": d.size(obs_ids),
        "k_unanswered": d.size(d.except_(call_ids, obs_ids)),
        "k_dangling": d.size(d.except_(obs_ids, call_ids)),
        "writes": f"{d.count(calls, 'c', 'coalesce(c.tool_name, ' + chr(39) * 2 + ') IN ' + str(WRITE_TOOLS))}",
        "n_typed": d.count(agents, "s", "s.call_type IS NOT NULL"),
        "n_sub": d.count(s, "s", "coalesce(s.call_type, '') = 'subagent'"),
        "n_sub_parent": d.count(s, "s", "coalesce(s.call_type, '') = 'subagent' AND s.parent_step IS NOT NULL"),
        "n_tok": d.count(agents, "s", f"{tok('input_tokens')} > 0 OR {tok('output_tokens')} > 0 OR {tok('cache_read_tokens')} > 0"),
        "n_tok_any": d.count(agents, "s", f"{tok('input_tokens')} > 0 OR {tok('output_tokens')} > 0"),
        "n_tok_both": d.count(agents, "s", f"{tok('input_tokens')} > 0 AND {tok('output_tokens')} > 0"),
        "n_time": d.count(s, "s", "s.timestamp IS NOT NULL"),
        "n_model": d.count(agents, "s", filled("s.model")),
        "n_content": d.count(agents, "s", f"{filled('s.content')} OR {d.size('s.tool_calls')} > 0"),
        "n_snips": d.size(snips),
        "n_snip_lang": d.count(snips, "p", filled("p.language")),
        "n_reason": d.count(s, "s", filled("s.reasoning_content")),
        "n_agent_reason": d.count(agents, "s", f"{filled('s.reasoning_content')} AND s.reasoning_content NOT LIKE '%[encrypted%'"),
        "n_agent_enc": d.count(agents, "s", "coalesce(s.reasoning_content, '') LIKE '%[encrypted%'"),
        "n_tool_steps": d.size(with_tools),
        "n_tool_reason": d.count(with_tools, "s", f"{filled('s.reasoning_content')} AND s.reasoning_content NOT LIKE '%[redacted%'"),
        "n_tool_redacted": d.count(with_tools, "s", "coalesce(s.reasoning_content, '') LIKE '%[redacted%'"),
        "n_turns": d.size(plain),
        "n_same": d.count(d.range(f"{d.size(plain)} - 1"), "i", f"{d.at(plain, 'i')} = {d.at(plain, 'i + 1')}"),
        "last_warmup": f"coalesce({d.max(at(chr(61) + ' ' + chr(39) + 'warmup' + chr(39)))}, -1)",
        "first_main": f"coalesce({d.min(at('IN (' + chr(39) + 'main' + chr(39) + ', ' + chr(39) + 'subagent' + chr(39) + ')'))}, 2147483647)",
        "total_steps": "coalesce(metrics.total_steps, 0)",
        "cache_rate": "metrics.cache_hit_rate",
        "cost": "coalesce(metrics.estimated_cost_usd, 0)",
        "duration": "coalesce(metrics.total_duration_s, 0)",
        "confidence": "coalesce(outcome.signal_confidence, 'derived')",
        "success": "outcome.success",
        "committed": "coalesce(outcome.committed, false)",
        "has_sha": filled("outcome.commit_sha"),
        "has_patch": filled("outcome.patch"),
        "terminal": "coalesce(outcome.terminal_state, '')",
        "has_reward": "outcome.reward IS NOT NULL",
        "has_reward_source": filled("outcome.reward_source"),
        "scanned": "coalesce(security.scanned, false)",
        "n_files": d.size("attribution.files"),
        "has_attribution": "attribution IS NOT NULL",
        "leaks": d.matches(f"concat_ws(' ', {texts}, task.description, environment.vcs.diff)", r"sk-ant-[A-Za-z0-9_-]{20}|AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{30}|-----BEGIN [A-Z ]*PRIVATE KEY|xox[bp]-[0-9A-Za-z-]{20}"),
    }


def _share(a: str, b: str) -> str:
    return f"(CASE WHEN {b} > 0 THEN CAST({a} AS double) / {b} ELSE 0.0 END)"


def _flag(x: str) -> str:
    return f"(CASE WHEN {x} THEN 1.0 ELSE 0.0 END)"


def checks() -> list[Check]:
    """The rubric: name, persona, category, weight, when it is skipped, when it passes, its score (0 to 1)."""
    no, yes = "false", "true"
    out: list[Check] = []

    def add(persona: str, category: str, name: str, weight: float, passed: str, score: str | None = None, skipped: str = no) -> None:
        out.append(Check(name, persona, category, weight, skipped, passed, score or _flag(passed)))

    c = lambda *a, **k: add("conformance", *a, **k)
    c("identity", "C1", 1.0, f"version = '{SCHEMA_VERSION}'")
    c("identity", "C2", 1.0, "length(id) >= 32 AND id LIKE '%-%'", _flag("length(id) >= 32"))
    c("identity", "C3", 1.0, "hash_len = 64")
    c("identity", "C4", 1.0, "agent_name <> ''")
    c("identity", "C5", 0.8, "has_start AND has_end", f"0.5 * {_flag('has_start')} + 0.5 * {_flag('has_end')}")
    c("steps", "C6", 1.0, "n_steps >= 2")
    c("steps", "C7", 1.0, "bad_roles = 0")
    c("steps", "C8", 1.0, "idx_distinct = n_steps AND idx_falls = 0", f"0.5 * {_flag('idx_distinct = n_steps')} + 0.5 * {_flag('idx_falls = 0')}")
    c("steps", "C9", 0.9, "n_calls = 0 OR n_call_ids = n_calls", _share("n_call_ids", "n_calls"))
    c("steps", "C10", 0.9, "n_obs = 0 OR n_obs_ids = n_obs", _share("n_obs_ids", "n_obs"))
    c("steps", "C11", 0.8, f"{_share('n_typed', 'n_agent')} > 0.8", _share("n_typed", "n_agent"), "conv")
    c("steps", "C12", 0.8, f"n_sub = 0 OR {_share('n_sub_parent', 'n_sub')} > 0.8", f"CASE WHEN n_sub = 0 THEN 1.0 ELSE {_share('n_sub_parent', 'n_sub')} END")
    c("steps", "C13", 0.9, f"{_share('n_tok', 'n_agent')} > 0.5", _share("n_tok", "n_agent"))
    c("content", "C14", 0.6, "n_snips > 0", "least(CAST(n_snips AS double) / 5, 1.0)", "rt AND writes = 0")
    c("content", "C15", 0.7, "task_len > 0")
    c("content", "C16", 0.6, "n_reason > 0", "least(CAST(n_reason AS double) / 3, 1.0)")
    c("enrichment", "C17", 0.8, "vcs IN ('git', 'none')")
    c("enrichment", "C18", 0.9, "total_steps > 0")
    c("enrichment", "C19", 0.7, "cache_rate IS NOT NULL", skipped="rt")
    c("enrichment", "C20", 0.7, "cost > 0")
    c("enrichment", "C21", 0.6, "duration > 0", skipped="rt")
    c("enrichment", "C22", 0.7, "confidence IN ('derived', 'inferred', 'annotated')")
    c("security", "C23", 0.8, "scanned")
    c("security", "C24", 1.0, "NOT leaks")
    c("security", "C25", 0.8, yes)
    c("format", "C26", 1.0, yes)
    c("format", "C27", 0.8, yes)
    c("format", "C28", 0.5, "bad_refs = 0", f"CASE WHEN n_refs = 0 THEN 1.0 ELSE {_share('(n_refs - bad_refs)', 'n_refs')} END")
    t = lambda *a, **k: add("training", *a, **k)
    ratio = f"CASE WHEN n_turns < 2 THEN 1.0 ELSE 1.0 - {_share('n_same', '(n_turns - 1)')} END"
    t("structure", "T1", 1.0, f"({ratio}) >= (CASE WHEN conv THEN 0.5 ELSE 0.9 END)", ratio)
    answered = f"CASE WHEN k_calls = 0 THEN 1.0 ELSE {_share('(k_calls - k_unanswered)', 'k_calls')} END"
    t("structure", "T2", 1.0, f"({answered}) >= 0.95", answered)
    linked = f"CASE WHEN k_obs = 0 THEN 1.0 ELSE {_share('(k_obs - k_dangling)', 'k_obs')} END"
    t("structure", "T3", 0.9, f"({linked}) >= 0.95", linked)
    t("content", "T4", 0.7, "n_prompts > 0")
    t("content", "T5", 0.8, f"{_share('n_content', 'n_agent')} >= 0.9", _share("n_content", "n_agent"))
    cover = f"CASE WHEN n_tool_steps = 0 THEN 1.0 ELSE {_share('(n_tool_reason + 0.5 * n_tool_redacted)', 'n_tool_steps')} END"
    t("content", "T6", 0.8, f"({cover}) >= 0.8", cover)
    t("content", "T7", 0.5, "n_agent_reason + n_agent_enc > 0", _share("(n_agent_reason + 0.5 * n_agent_enc)", "n_agent"))
    t("content", "T8", 0.6, "task_len > 0")
    t("signal", "T9", 0.7, "committed OR success IS NOT NULL OR terminal <> '' OR has_reward")
    ordered = "CASE WHEN n_typed = 0 THEN 0.0 WHEN last_warmup < 0 THEN 0.5 WHEN last_warmup < first_main THEN 1.0 ELSE 0.3 END"
    t("signal", "T10", 0.5, "n_typed > 0 AND (last_warmup < 0 OR last_warmup < first_main)", ordered, "conv")
    r = lambda *a, **k: add("rl", *a, **k)
    ladder = (
        "CASE WHEN rt THEN (CASE WHEN has_reward THEN 1.0 WHEN terminal = 'goal_reached' THEN 0.8 WHEN terminal <> '' THEN 0.6 ELSE 0.0 END)"
        " WHEN committed THEN 1.0 WHEN has_sha OR has_patch THEN 0.3 WHEN success = false THEN 0.6 ELSE 0.0 END"
    )
    r("outcome", "RL1", 1.0, f"({ladder}) >= 0.6", ladder)
    trust = (
        "CASE WHEN committed OR confidence = 'annotated' THEN 1.0 WHEN has_reward AND has_reward_source THEN 0.9 WHEN confidence = 'derived' AND success IS NOT NULL THEN 0.8"
        " WHEN confidence = 'inferred' AND terminal <> '' THEN 0.6 WHEN confidence = 'inferred' AND success IS NOT NULL THEN 0.5 ELSE 0.0 END"
    )
    r("outcome", "RL2", 1.0, f"({trust}) > 0", trust)
    r("outcome", "RL3", 0.9, "NOT committed OR has_patch")
    r("cost", "RL4", 0.8, f"{_share('n_tok_any', 'n_agent')} >= 0.8", _share("n_tok_any", "n_agent"), "conv")
    r("cost", "RL5", 0.7, "cost > 0")
    parents = f"CASE WHEN n_sub = 0 THEN 1.0 ELSE {_share('n_sub_parent', 'n_sub')} END"
    r("structure", "RL6", 0.7, f"({parents}) >= 0.9", parents)
    r("outcome", "RL7", 0.4, "success IS NOT NULL OR terminal <> '' OR has_reward", "CASE WHEN success IS NOT NULL OR has_reward THEN 1.0 WHEN terminal <> '' THEN 0.8 ELSE 0.0 END")
    r("structure", "RL8", 0.3, f"{_share('n_model', 'n_agent')} >= 0.5", _share("n_model", "n_agent"))
    a = lambda *x, **k: add("analytics", *x, **k)
    a("cost", "A1", 1.0, "cache_rate IS NOT NULL AND cache_rate >= 0 AND cache_rate <= 1", skipped="rt")
    a("cost", "A2", 0.9, "cost > 0")
    a("time", "A3", 0.8, "duration > 0", skipped="rt")
    a("time", "A4", 0.7, f"{_share('n_time', 'n_steps')} >= 0.8", _share("n_time", "n_steps"), "conv")
    a("cost", "A5", 0.8, f"{_share('n_tok_both', 'n_agent')} >= 0.8", _share("n_tok_both", "n_agent"), "conv")
    a("structure", "A6", 0.6, f"{_share('n_model', 'n_agent')} >= 0.5", _share("n_model", "n_agent"))
    a("structure", "A7", 0.5, "total_steps = n_steps")
    a("structure", "A8", 0.4, f"{_share('n_typed', 'n_agent')} >= 0.5", _share("n_typed", "n_agent"), "conv")
    m = lambda *x, **k: add("domain", *x, **k)
    m("content", "D1", 1.0, "n_lang > 0", skipped="rt AND writes = 0")
    m("content", "D2", 0.9, "n_lang = 0 OR n_deps > 0")
    m("content", "D3", 0.8, "task_len > 10", "CASE WHEN task_len > 10 THEN 1.0 WHEN task_len > 0 THEN 0.5 ELSE 0.0 END")
    m("context", "D4", 0.7, "vcs <> '' AND branch", f"0.5 * {_flag(chr(118) + 'cs <> ' + chr(39) * 2)} + 0.5 * {_flag('branch')}", "rt")
    m("content", "D5", 0.6, f"{_share('n_snip_lang', 'n_snips')} >= 0.5", _share("n_snip_lang", "n_snips"), "n_snips = 0")
    m("content", "D6", 0.5, "writes = 0 OR n_files > 0", "CASE WHEN writes = 0 OR n_files > 0 THEN 1.0 WHEN has_attribution THEN 0.3 ELSE 0.0 END")
    m("context", "D7", 0.5, "agent_name <> '' AND (agent_version <> '' OR rt)", "CASE WHEN agent_name <> '' AND agent_version <> '' THEN 1.0 WHEN agent_name <> '' AND rt THEN 0.7 WHEN agent_name <> '' THEN 0.5 ELSE 0.0 END")
    m("context", "D8", 0.3, yes, _flag("os"))
    return out


def check_results(traces: DataFrame, custom: list[Check] | None = None) -> DataFrame:
    """One row per trace and check: row_id, persona, check_name, category, weight, skipped, passed, score.

    ``custom`` replaces the rubric by checks over the same features.
    """
    feats = traces.selectExpr("row_id", *[f"{x} AS {n}" for n, x in features(SPARK).items()])
    return feats.selectExpr("row_id", f"inline(array({', '.join(_row(SPARK, c) for c in custom or checks())}))")


def _row(d: Dialect, c: Check) -> str:
    return d.struct(
        persona=f"'{c.persona}'", check_name=f"'{c.name}'", category=f"'{c.category}'", weight=f"CAST({c.weight} AS double)",
        skipped=f"({c.skipped})", passed=f"({c.passed})", score=d.round(c.score, 3),
    )


def oracle_results() -> str:
    feats = ", ".join(f"{x} AS {n}" for n, x in features(DUCK).items())
    rows = ", ".join(_row(DUCK, c) for c in checks())
    return f"SELECT row_id, u.* FROM (SELECT row_id, unnest([{rows}]) AS u FROM (SELECT row_id, {feats} FROM traces))"


PERSONAS = ("conformance", "training", "rl", "analytics", "domain")


def _scored(traces: DataFrame, custom: list[Check] | None = None) -> DataFrame:
    """row_id and, per persona, a struct of its score over the checks of the record; one projection, no shuffle."""
    feats = traces.selectExpr("row_id", *[f"{x} AS {n}" for n, x in features(SPARK).items()])
    rubric = custom or checks()
    by = {p: [c for c in rubric if c.persona == p] for p in dict.fromkeys(c.persona for c in rubric)}
    out = feats.selectExpr("row_id", *[f"array({', '.join(_row(SPARK, c) for c in cs)}) AS `{p}`" for p, cs in by.items()])

    def total(x: str, of: str) -> str:
        return f"aggregate({of}, CAST(0 AS double), (acc, c) -> acc + {x})"

    cols = []
    for p in by:
        used = f"filter(`{p}`, c -> NOT c.skipped)"
        score = f"coalesce(bround({total('c.weight * c.score', used)} / nullif({total('c.weight', used)}, 0D) * 100, 1), 0D)"
        rate = f"coalesce(bround({total('CAST(c.passed AS double)', used)} / nullif(size({used}), 0), 3), 0D)"
        cols.append(f"named_struct('persona', '{p}', 'total_score', {score}, 'pass_rate', {rate}, 'skipped', size({used}) = 0) AS `{p}`")
    return out.selectExpr("row_id", *cols)


def trace_scores(traces: DataFrame, custom: list[Check] | None = None) -> DataFrame:
    """Weighted score (0 to 100) and pass rate per trace and persona; all skipped: skipped, score 0."""
    s = _scored(traces, custom)
    return s.selectExpr("row_id", f"inline(array({', '.join(f'`{c}`' for c in s.columns[1:])}))")


def trace_utilities(traces: DataFrame, custom: list[Check] | None = None) -> DataFrame:
    """Mean of the persona scores of a trace that were not skipped."""
    s = _scored(traces, custom)
    used = f"filter(array({', '.join(f'`{c}`' for c in s.columns[1:])}), p -> NOT p.skipped)"
    return s.selectExpr("row_id", f"bround(aggregate({used}, 0D, (acc, p) -> acc + p.total_score) / nullif(size({used}), 0), 1) AS overall_utility")


def batch_summary(scores: DataFrame) -> DataFrame:
    """Per persona: traces scored, lowest, highest and mean score."""
    s = F.when(~F.col("skipped"), F.col("total_score"))
    return scores.groupBy("persona").agg(F.count(s).alias("n_scored"), F.min(s).alias("min_score"), F.max(s).alias("max_score"), F.bround(F.avg(s), 1).alias("avg_score"))


def breakdown(results: DataFrame) -> DataFrame:
    """Per check: traces, mean score, pass rate and status."""
    used = ~F.col("skipped")
    out = results.groupBy("persona", "check_name").agg(
        F.count(F.when(used, 1)).alias("n"), F.bround(F.avg(F.when(used, F.col("score"))) * 100, 1).alias("avg_score"), F.bround(F.avg(F.when(used, F.col("passed").cast("double"))) * 100, 1).alias("pass_rate")
    )
    return out.withColumn("status", F.when(F.col("avg_score") >= 90, "ok").when(F.col("avg_score") >= 50, "WARN").otherwise("CRITICAL"))


def category_scores(results: DataFrame) -> DataFrame:
    """Weighted score per persona and category over all traces."""
    used = ~F.col("skipped")
    return results.groupBy("persona", "category").agg(F.bround(F.sum(F.when(used, F.col("weight") * F.col("score"))) / F.sum(F.when(used, F.col("weight"))) * 100, 1).alias("score"))


def gate(summary: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Per persona whether the batch passes; ``thresholds``(persona, min_individual, min_average) is the caller's table of a few rows.

    A persona without a threshold is not gated; a null bound does not apply.
    """
    out = summary.join(F.broadcast(thresholds.select("persona", "min_individual", "min_average")), "persona", "left")
    low, mean = F.coalesce(F.col("min_score") < F.col("min_individual"), F.lit(False)), F.coalesce(F.col("avg_score") < F.col("min_average"), F.lit(False))
    return out.select("persona", "min_score", "avg_score", low.alias("individual_failed"), mean.alias("average_failed"), (~low & ~mean).alias("passed"))
