"""Queries of the screening and enrichment operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from spanforge.functions.dialect import DUCK, SPARK
from spanforge.operators import enrich, protect, screening
from spanforge.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

_CALLS = "row_id bigint, steps array<struct<tool_calls:array<struct<tool_call_id:string, tool_name:string, input:string>>, observations:array<struct<source_call_id:string, content:string>>>>"


def _over(name: str, tab: str, key: str, f, schema: str | None = None) -> None:
    QUERIES[name] = lambda s, d: table(s, d, tab, schema).selectExpr(key, *[f"{e} AS {n}" for n, e in f(SPARK).items()])
    ORACLE[name] = f"SELECT {key}, " + ", ".join(f"{e} AS {n}" for n, e in f(DUCK).items()) + f" FROM {tab}"


def _rows(name: str, source, cols, schema: str | None = None) -> None:
    QUERIES[name] = lambda s, d: table(s, d, "traces", schema).selectExpr("row_id", f"inline({source(SPARK)})").selectExpr("row_id", *[f"{e} AS {n}" for n, e in cols(SPARK).items()])
    ORACLE[name] = "SELECT row_id, " + ", ".join(f"{e} AS {n}" for n, e in cols(DUCK).items()) + f" FROM (SELECT row_id, u.* FROM (SELECT row_id, unnest({source(DUCK)}) AS u FROM traces))"


_TEXTS = (
    "row_id bigint, task struct<description:string>, environment struct<vcs:struct<diff:string>>, outcome struct<description:string, patch:string>, "
    "steps array<struct<content:string, reasoning_content:string, tool_calls:array<struct<input:string>>, observations:array<struct<content:string>>>>"
)
_text = "coalesce(text, '')"
_over("doc_entropy", "documents", "doc_id", lambda d: {"bits": screening.entropy(d, _text)})
_over("doc_scan", "documents", "doc_id", lambda d: screening.counts(d, _text))
_over("doc_redacted", "documents", "doc_id", lambda d: {"redacted": screening.redact(d, _text)})
_over("doc_classifier", "documents", "doc_id", lambda d: screening.classifier(d, _text))
_over("doc_anonymous_paths", "documents", "doc_id", lambda d: {"text": screening.anonymous_paths(d, _text), "users": d.size(screening.usernames(d, _text))})
_over("part_luhn", "orders", "o_orderkey", lambda d: {"valid": screening.luhn(d, "concat('4000', lpad(CAST(o_orderkey AS " + ("string" if d.spark else "VARCHAR") + "), 12, '0'))")})
_rows("trace_text_fields", screening.text_fields, lambda d: {"path": "path", "field_type": "field_type", "n_chars": "length(text)"}, _TEXTS)
_rows("trace_scan", screening.text_fields, lambda d: {"path": "path", "field_type": "field_type"} | screening.counts(d, "text"), _TEXTS)
_rows("trace_classifier", screening.text_fields, lambda d: {"path": "path"} | screening.classifier(d, "text"), _TEXTS)
_rows("trace_anonymous_paths", screening.text_fields, lambda d: {"path": "path", "text": screening.anonymous_paths(d, "text")}, _TEXTS)
_rows("call_languages", enrich.flat_calls, lambda d: {"step_pos": "step_pos", "call_pos": "call_pos", "language": enrich.language(d, enrich.key(d, "input", "file_path")), "n_lines": enrich.line_count(d, enrich.key(d, "input", "content"))}, _CALLS)
_rows("call_commits", enrich.flat_calls, lambda d: {"step_pos": "step_pos", "call_pos": "call_pos"} | enrich.commits(d), _CALLS)
_rows("call_installs", enrich.flat_calls, lambda d: {"step_pos": "step_pos", "call_pos": "call_pos", "packages": enrich.installs(d)}, _CALLS)
_rows("call_imports", enrich.flat_calls, lambda d: {"step_pos": "step_pos", "call_pos": "call_pos", "modules": enrich.imports(d, "content")}, _CALLS)
_rows("trace_hunks", lambda d: enrich.hunks(d, "environment.vcs.diff"), lambda d: {"file_path": "file_path", "start_line": "start_line", "end_line": "end_line"}, "row_id bigint, environment struct<vcs:struct<diff:string>>")
QUERIES["trace_ecosystem"] = lambda s, d: table(s, d, "traces", _CALLS).selectExpr("row_id", f"{enrich.ecosystem(SPARK)} AS languages")
ORACLE["trace_ecosystem"] = f"SELECT row_id, {enrich.ecosystem(DUCK)} AS languages FROM traces"
QUERIES["trace_dependencies"] = lambda s, d: table(s, d, "traces", _CALLS + ", dependencies array<string>").selectExpr("row_id", f"{enrich.dependencies(SPARK)} AS packages")
ORACLE["trace_dependencies"] = f"SELECT row_id, {enrich.dependencies(DUCK)} AS packages FROM traces"
QUERIES["trace_attribution"] = lambda s, d: enrich.attribution(table(s, d, "traces", _CALLS))

_RECORD = (
    "row_id bigint, system_prompts map<string,string>, task struct<description:string>, environment struct<vcs:struct<diff:string>>, outcome struct<description:string, patch:string>, "
    "steps array<struct<content:string, reasoning_content:string, tool_calls:array<struct<tool_name:string, input:string>>, observations:array<struct<content:string, output_summary:string, error:string>>, snippets:array<struct<text:string>>>>, "
    "security struct<scanned:boolean, redactions_applied:bigint>"
)
QUERIES["record_assessment"] = lambda s, d: protect.assessments(table(s, d, "traces", _RECORD))
QUERIES["record_redacted"] = lambda s, d: protect.redacted(table(s, d, "traces", _RECORD)).selectExpr("row_id", "task.description AS task", "to_json(steps) AS steps", "security.redactions_applied AS n_redactions")
