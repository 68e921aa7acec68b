"""Signals derived from a record's tool calls, observations and diff.

Everything but the attribution fold is an expression over one record, so nothing
is shuffled.  The fold follows each file's text through its edits; its state is
the record's own, so it runs over Arrow batches of records, not over groups.

Null or absent arrays and structs count as empty; an input that is no JSON
object has no command, file or text.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from spanforge.functions.dialect import SPARK, Dialect

# Extension to language.
LANGUAGES = {
    "py": "python", "pyi": "python", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "tsx", "go": "go", "rs": "rust", "rb": "ruby", "java": "java",
    "kt": "kotlin", "swift": "swift", "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "hpp": "cpp", "cs": "csharp", "php": "php", "sh": "shell", "bash": "shell", "zsh": "shell", "sql": "sql", "html": "html", "css": "css",
    "scss": "scss", "json": "json", "yaml": "yaml", "yml": "yaml", "toml": "toml", "xml": "xml", "md": "markdown", "ex": "elixir", "exs": "elixir", "scala": "scala", "lua": "lua", "r": "r",
}
# Modules that come with a language.
BUILTIN = ("os", "sys", "re", "json", "time", "math", "typing", "pathlib", "datetime", "collections", "itertools", "functools", "logging", "subprocess", "fs", "path", "http", "https", "util", "fmt", "strings", "errors", "io", "set")


def flat_calls(d: Dialect) -> str:
    """Array of (step_pos, call_pos, tool_name, input, content): each call with its step's first observation of the same id."""
    kind = "struct<step_pos:bigint,call_pos:bigint,tool_name:string,input:string,content:string>"
    el = d.at("steps", "i")
    call = d.at(f"{el}.tool_calls", "j")
    seen = d.at(d.filter(f"{el}.observations", "o", f"coalesce(o.source_call_id, '') <> '' AND o.source_call_id = {call}.tool_call_id"), "0")
    row = d.struct(step_pos="CAST(i AS bigint)", call_pos="CAST(j AS bigint)", tool_name=f"{call}.tool_name", input=f"{call}.input", content=f"{seen}.content")
    inner = d.map(d.range(d.size(f"{el}.tool_calls")), "j", row)
    return f"coalesce(flatten({d.map(d.range(d.size('steps')), 'i', inner)}), {d.empty(kind)})"


def key(d: Dialect, x: str, name: str) -> str:
    """A string field of a JSON input; '' if there is none."""
    return f"coalesce({d.json(x, name)}, '')" if d.spark else f"coalesce(CASE WHEN json_valid({x}) THEN {d.json(x, name)} END, '')"


def language(d: Dialect, path: str) -> str:
    ext = f"lower({d.extract(path, '[.]([A-Za-z0-9]+)$', 1)})"
    cases = " ".join(f"WHEN '{e}' THEN '{name}'" for e, name in LANGUAGES.items())
    return f"CASE WHEN {d.matches(path, '(^|/)Dockerfile$')} THEN 'dockerfile' ELSE (CASE {ext} {cases} END) END"


def line_count(d: Dialect, x: str) -> str:
    return f"CASE WHEN {x} = '' THEN 0 ELSE length({x}) - length(replace({x}, chr(10), '')) + 1 END"


def commits(d: Dialect) -> dict[str, str]:
    """Columns of a call row: whether it committed, the hash and the subject that the output shows."""
    command = key(d, "input", "command")
    pattern = r"\[[A-Za-z0-9_/.-]+(?: [(]root-commit[)])? ([0-9a-f]{7,40})\] ?([^\r\n]*)"
    return {"is_commit": f"{command} LIKE '%git commit%'", "sha": f"nullif({d.extract('coalesce(content, ' + chr(39) * 2 + ')', pattern, 1)}, '')", "subject": f"nullif({d.extract(command, '-m [^A-Za-z0-9]*([A-Za-z0-9][^' + chr(34) + ']*)', 1)}, '')"}


def installs(d: Dialect, arg: str = "input") -> str:
    """Packages of an install command, without flags and versions."""
    command = key(d, arg, "command")
    rest = d.extract(command, r"(?:npm install|npm i|yarn add|pnpm add|pip install|pip3 install|gem install|go get|cargo add) ([^&|;\r\n]*)", 1)
    bare = d.map(d.filter(d.split(rest, " "), "w", "w <> '' AND w NOT LIKE '-%' AND w NOT LIKE '.%'"), "w", d.extract("w", r"^(@?[^@>=<~!]+)", 1))
    return d.sort(d.distinct(d.filter(bare, "w", "length(w) > 1")))


def imports(d: Dialect, x: str) -> str:
    """Modules that the import lines of a text name, without built-in and relative ones."""
    none = f"coalesce({x}, '')"
    py = d.extract_all(none, r"(?:^|\n)[ \t]*(?:[0-9]+→)?(?:from|import) ([A-Za-z_][A-Za-z0-9_]*)", 1)
    js = d.extract_all(none, r"(?:require[(]|from )[\x22\x27]([A-Za-z@][A-Za-z0-9@/_.-]*)[\x22\x27]", 1)
    rb = d.extract_all(none, r"(?:^|\n)[ \t]*(?:[0-9]+→)?require [\x22\x27]([A-Za-z0-9_/.-]+)[\x22\x27]", 1)
    go = d.extract_all(none, r"(?:^|\n)[ \t]*(?:[0-9]+→)?(?:import )?\x22([a-z0-9-]+[.][a-z]{2,}/[A-Za-z0-9_./-]+)\x22", 1)
    both = f"concat({py}, {js}, {rb}, {go})" if d.spark else f"({py} || {js} || {rb} || {go})"
    return d.sort(d.distinct(d.filter(both, "w", f"length(w) > 1 AND lower(w) = w AND w NOT IN {BUILTIN}")))


def dependencies(d: Dialect) -> str:
    """What a record declares, installs and imports, sorted."""
    both = (lambda a, b: f"concat({a}, {b})") if d.spark else (lambda a, b: f"({a} || {b})")
    named = d.map(flat_calls(d), "c", both(installs(d, "c.input"), imports(d, "c.content")))
    return d.sort(d.distinct(d.filter(both(f"coalesce(dependencies, {d.empty()})", f"coalesce(flatten({named}), {d.empty()})"), "w", "length(w) > 1")))


def ecosystem(d: Dialect) -> str:
    """Languages of the files that a record's calls name, sorted."""
    files = d.map(flat_calls(d), "c", f"coalesce(nullif({key(d, 'c.input', 'file_path')}, ''), nullif({key(d, 'c.input', 'path')}, ''), '')")
    return d.sort(d.distinct(d.filter(d.map(files, "p", language(d, "p")), "x", "x IS NOT NULL")))


def hunks(d: Dialect, diff: str) -> str:
    """Array of (file_path, start_line, end_line) of the new side of a unified diff."""
    kind = "struct<file_path:string,start_line:bigint,end_line:bigint>"
    parts = d.filter(d.split(f"chr(10) || coalesce({diff}, '')", "\\n") if False else (f"split(concat('\\n', coalesce({diff}, '')), '\\ndiff --git ')" if d.spark else f"string_split(chr(10) || coalesce({diff}, ''), chr(10) || 'diff --git ')"), "p", "length(p) > 1")
    path = d.extract("p", r"[+]{3} (?:b/)?([^\r\n\t]+)", 1)
    head = d.extract_all("p", r"@@ -[0-9]+(?:,[0-9]+)? [+][0-9]+(?:,[0-9]+)? @@", 0)
    start, n = f"CAST({d.extract('h', '[+]([0-9]+)', 1)} AS bigint)", f"coalesce(TRY_CAST(nullif({d.extract('h', '[+][0-9]+,([0-9]+)', 1)}, '') AS bigint), 1)"
    rows = d.map(head, "h", d.struct(file_path=path, start_line=start, end_line=f"{start} + greatest({n} - 1, 0)"))
    return f"coalesce(flatten({d.map(parts, 'p', rows)}), {d.empty(kind)})"


def calls(traces: DataFrame, *cols: str) -> DataFrame:
    return traces.selectExpr("row_id", f"inline({flat_calls(SPARK)})").selectExpr("row_id", "step_pos", "call_pos", *cols)


def _lines(text: str) -> int:
    return text.count("\n") + 1


def fold_record(steps: list | None) -> list[tuple[str, int, int, int, str]]:
    """(file, step_pos, first line, last line, hash) of every edit of a record, following the files' texts."""
    held: dict[str, str] = {}
    out = []
    for i, s in enumerate(steps if steps is not None else []):
        if s is None:
            continue
        seen = {o["source_call_id"]: o["content"] for o in (s["observations"] if s["observations"] is not None else []) if o is not None and o["source_call_id"]}
        for c in s["tool_calls"] if s["tool_calls"] is not None else []:
            try:
                arg = json.loads(c["input"]) if c is not None and c["input"] else {}
            except ValueError:
                continue
            file = arg.get("file_path") if isinstance(arg, dict) else None
            if not isinstance(file, str) or not file:
                continue
            if c["tool_name"] == "Read" and isinstance(seen.get(c["tool_call_id"]), str):
                held[file] = seen[c["tool_call_id"]]
            elif c["tool_name"] == "Write" and isinstance(arg.get("content"), str):
                held[file] = arg["content"]
                out.append((file, i, 1, _lines(arg["content"]), hashlib.md5(arg["content"].encode()).hexdigest()[:8]))
            elif c["tool_name"] == "Edit" and isinstance(arg.get("new_string"), str):
                old, new, text = arg.get("old_string") or "", arg["new_string"], held.get(file, "")
                at = text.find(old) if old else -1
                first = text.count("\n", 0, at) + 1 if at >= 0 else 1
                if at >= 0:
                    held[file] = text[:at] + new + text[at + len(old) :]
                out.append((file, i, first, first + _lines(new) - 1, hashlib.md5(new.encode()).hexdigest()[:8]))
    return out


def confidence(ranges: list[tuple[int, int]]) -> str:
    """high for one edit, low if neighbours by first line overlap, else medium."""
    if len(ranges) == 1:
        return "high"
    s = sorted(ranges)
    return "low" if any(b[0] <= a[1] for a, b in zip(s, s[1:], strict=False)) else "medium"


def attribution(traces: DataFrame) -> DataFrame:
    """(row_id, file_path, step_pos, start_line, end_line, content_hash, confidence) of every edit."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for row_id, steps in zip(pdf["row_id"], pdf["steps"], strict=True):
                edits = fold_record(steps)
                by: dict[str, list[tuple[int, int]]] = {}
                for f, _, a, b, _ in edits:
                    by.setdefault(f, []).append((a, b))
                rows += [(row_id, f, i, a, b, h, confidence(by[f])) for f, i, a, b, h in edits]
            yield pd.DataFrame(rows, columns=["row_id", "file_path", "step_pos", "start_line", "end_line", "content_hash", "confidence"])

    return traces.select("row_id", "steps").mapInPandas(fold, "row_id bigint, file_path string, step_pos bigint, start_line bigint, end_line bigint, content_hash string, confidence string")
