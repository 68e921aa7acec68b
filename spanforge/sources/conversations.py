"""Conversation dataset rows (tagged text) to steps.

A row is one conversation and its turns depend on those before, so rows are
folded one by one over Arrow batches; nothing is shuffled.

Defined results: null rows and conversations give no steps; malformed tool calls
are skipped but counted; responses are linked by position, those left over stay
unlinked; texts are read whole.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SUMMARY_CHARS = 200
_THINK = re.compile(r"<think>(.*?)</think>", re.S)
_CALL = re.compile(r"<tool_call>(.*?)</tool_call>", re.S)
_RESPONSE = re.compile(r"<tool_response>(.*?)</tool_response>", re.S)
# Names of roles and tools in other datasets.
ROLES = {"human": "user", "user": "user", "gpt": "agent", "assistant": "agent", "system": "system", "tool": "tool", "function": "tool"}
TOOLS = {"terminal": "Bash", "write_file": "Write", "read_file": "Read", "patch": "Edit", "search_files": "Grep", "execute_code": "Bash", "process": "Bash"}
# Names of arguments, by the tool's name in the dataset.
ARGUMENTS = {"patch": {"path": "file_path", "original": "old_string", "replacement": "new_string"}, "write_file": {"path": "file_path"}, "read_file": {"path": "file_path"}}

STEP = "row_key string, step_index bigint, role string, content string, reasoning_content string, system_prompt_hash string, calls array<struct<tool_call_id:string, tool_name:string, input:string>>, observations array<struct<source_call_id:string, content:string, output_summary:string, error:string>>, n_malformed int"


def _call(raw: str, step: int, i: int) -> dict | None:
    try:
        o = json.loads(raw)
    except ValueError:
        return None
    if not isinstance(o, dict) or not isinstance(o.get("name"), str):
        return None
    args = o.get("arguments", {})
    if isinstance(args, str):
        try:
            args = json.loads(args)
        except ValueError:
            args = {"raw": args}
    if isinstance(args, dict):
        renamed = ARGUMENTS.get(o["name"], {})
        args = {renamed.get(k, k): v for k, v in args.items()}
    return {"tool_call_id": str(o.get("id") or f"tc_{step}_{i}"), "tool_name": TOOLS.get(o["name"], o["name"]), "input": json.dumps(args, sort_keys=True)}


def _response(raw: str) -> dict:
    try:
        o = json.loads(raw)
    except ValueError:
        return {"source_call_id": None, "content": raw.strip(), "error": None}
    if isinstance(o, dict):
        body = o.get("content", o)
        return {"source_call_id": o.get("tool_call_id"), "content": body if isinstance(body, str) else json.dumps(body, sort_keys=True), "error": None}
    return {"source_call_id": None, "content": json.dumps(o), "error": None}


def fold_turns(turns: list[tuple[str | None, str | None]]) -> list[dict]:
    """Steps of (role, text) turns: responses go to the last agent step, calls and responses meet by position."""
    steps: list[dict] = []
    prompt = None
    for role, text in turns:
        role, text = ROLES.get((role or "").strip().lower(), "user"), text or ""
        if role == "system":
            prompt = hashlib.sha256(text.encode()).hexdigest()[:16]
            continue
        answers = [_response(m) for m in _RESPONSE.findall(text)]
        if role == "tool" or (answers and not _RESPONSE.sub("", text).strip()):
            if role == "tool" and not answers:
                answers = [_response(text)]
            agent = next((s for s in reversed(steps) if s["role"] == "agent"), None)
            if agent is not None:
                taken = len(agent["observations"])
                for k, a in enumerate(answers):
                    if a["source_call_id"] is None:
                        if taken + k < len(agent["calls"]):
                            a["source_call_id"] = agent["calls"][taken + k]["tool_call_id"]
                        else:
                            a["error"] = "unlinked_response"
                    a["output_summary"] = a["content"] if len(a["content"]) <= SUMMARY_CHARS else a["content"][:SUMMARY_CHARS] + "..."
                agent["observations"] += answers
            continue
        n = len(steps)
        raw = _CALL.findall(text) if role == "agent" else []
        calls = [c for i, m in enumerate(raw) if (c := _call(m.strip(), n, i))]
        plain = _RESPONSE.sub("", _CALL.sub("", _THINK.sub("", text))).strip()
        think = " ".join(t.strip() for t in _THINK.findall(text) if t.strip())
        steps.append({"step_index": n, "role": role, "content": plain, "reasoning_content": think or None, "system_prompt_hash": prompt if role == "agent" else None, "calls": calls, "observations": [], "n_malformed": len(raw) - len(calls)})
    return steps


def conversation_steps(rows: DataFrame, key: str = "row_key", turns: str = "conversations") -> DataFrame:
    """Steps of every row; ``turns`` is an array of structs with role (or from) and content (or value)."""
    fields = rows.schema[turns].dataType.elementType.names
    role, text = ("role" if "role" in fields else "from"), ("content" if "content" in fields else "value")
    src = rows.select(F.col(key).cast("string").alias("k"), F.transform(turns, lambda t: F.struct(t[role].alias("r"), t[text].alias("t"))).alias("turns"))

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for k, ts in zip(pdf["k"], pdf["turns"], strict=True):
                if ts is not None:
                    out += [{"row_key": k, **s} for s in fold_turns([(t["r"], t["t"]) for t in ts if t is not None])]
            yield pd.DataFrame(out, columns=["row_key", "step_index", "role", "content", "reasoning_content", "system_prompt_hash", "calls", "observations", "n_malformed"])

    return src.mapInPandas(fold, STEP)


def success_rate(stats: Column) -> Column:
    """1 - failures / calls over a map of tool to (count, success, failure)."""
    total = F.aggregate(F.map_values(stats), F.lit(0).cast("bigint"), lambda a, v: a + F.coalesce(v["count"], F.lit(0)))
    failed = F.aggregate(F.map_values(stats), F.lit(0).cast("bigint"), lambda a, v: a + F.coalesce(v["failure"], F.lit(0)))
    return F.when(total > 0, F.bround(1 - failed / total, 3))
