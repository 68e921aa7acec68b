"""Record-level screening: findings by kind of field, redaction that rebuilds the record, risk and review.

A record is its own unit of work, so records go through Arrow batches one by one
and nothing is shuffled.  What a field is decides what is looked for: inputs and
general texts are also searched for random-looking strings and card numbers,
results and reasoning for patterns only.  Tool inputs are JSON: their texts are
walked at any depth, and a redacted input is valid JSON again.

Defined results
    * null records, arrays, structs and texts hold nothing; an input that is no
      JSON is screened and redacted as one text;
    * overlapping findings are one, from the first start to the last end;
    * a second pass over the serialized record counts what the fields did not show;
    * a record is to be reviewed if either pass finds anything.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from spanforge.operators.screening import PATTERNS

MARK = "[REDACTED]"
# Tools by what their input is.
INPUT_TOOLS = ("bash", "write", "edit")
RESULT_TOOLS = ("read", "grep", "glob")
GENERAL, INPUT, RESULT, REASONING = "general", "tool_input", "tool_result", "reasoning"
#: a word of so many characters and bits a character is taken for a secret
RANDOM_LENGTH, RANDOM_BITS = 20, 4.0

_COMPILED = [(name, re.compile(pattern), re.compile(allowed) if allowed else None) for name, _, pattern, allowed in PATTERNS]
_RANDOM = re.compile(rf"[A-Za-z0-9+/=_-]{{{RANDOM_LENGTH},}}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])")
_PLAIN_ID = re.compile(r"[0-9a-f-]+|[0-9]+|[A-Za-z_]+|[a-z]+(?:[-_/][a-z0-9]+)+", re.I)


def tool_class(name: str | None) -> str:
    """Whether a tool's input is an input or names results; the last part of a namespaced name counts, unknown tools are inputs."""
    base = (name or "").rsplit("__", 1)[-1]
    return RESULT if base.lower() in RESULT_TOOLS and base in (base.lower(), base.capitalize()) else INPUT


def bits(text: str) -> float:
    n = len(text)
    return -sum(c / n * math.log2(c / n) for c in Counter(text).values()) if n else 0.0


def check_sum(digits: str) -> bool:
    """The card check sum of 13 to 19 digits."""
    d = [int(c) for c in digits if c.isdigit()]
    twice = [x * 2 - 9 * (x > 4) if i % 2 else x for i, x in enumerate(reversed(d))]
    return 13 <= len(d) <= 19 and len(set(d)) > 1 and sum(twice) % 10 == 0


def findings(text: str | None, kind: str) -> list[tuple[str, int, int]]:
    """(pattern, start, end) in a text of a kind of field, by position."""
    if not text:
        return []
    out = [(name, *m.span()) for name, pattern, allowed in _COMPILED for m in pattern.finditer(text) if not (allowed and allowed.search(m[0]))]
    out += [("credit_card", *m.span()) for m in _CARD.finditer(text) if check_sum(m[0])]
    if kind in (GENERAL, INPUT):
        out += [("high_entropy", *m.span()) for m in _RANDOM.finditer(text) if not _PLAIN_ID.fullmatch(m[0]) and bits(m[0]) >= RANDOM_BITS]
    return sorted(out, key=lambda f: (f[1], -f[2], f[0]))


def merged(found: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for _, a, b in found:
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def redact(text: str, kind: str) -> tuple[str, int]:
    """The text without its findings, and how many there were."""
    spans = merged(findings(text, kind))
    for a, b in reversed(spans):
        text = text[:a] + MARK + text[b:]
    return text, len(spans)


def walk(o: object, change: Callable[[str], str]) -> object:
    """A JSON value with ``change`` applied to its texts at any depth; keys stay."""
    if isinstance(o, str):
        return change(o)
    if isinstance(o, dict):
        return {k: walk(v, change) for k, v in o.items()}
    return [walk(v, change) for v in o] if isinstance(o, list) else o


def _input(raw: str, change: Callable[[str], str]) -> str:
    try:
        o = json.loads(raw)
    except (ValueError, RecursionError):
        return change(raw)
    new = walk(o, change)
    return raw if new == o else json.dumps(new, ensure_ascii=False)


def visit(record: dict, change: Callable[[str, str], str]) -> dict:
    """The record with ``change(text, kind of field)`` applied to all its texts."""

    def text(o: dict | None, key: str, kind: str) -> None:
        if o is not None and isinstance(o.get(key), str) and o[key]:
            o[key] = change(o[key], kind)

    prompts = record.get("system_prompts")
    if prompts:
        record["system_prompts"] = [(k, change(v, GENERAL) if v else v) for k, v in (prompts.items() if isinstance(prompts, dict) else prompts)]
    text(record.get("task"), "description", GENERAL)
    for s in record.get("steps") or []:
        text(s, "content", GENERAL)
        text(s, "reasoning_content", REASONING)
        for c in (s or {}).get("tool_calls") or []:
            if c and c.get("input"):
                kind = tool_class(c.get("tool_name"))
                c["input"] = _input(c["input"], lambda t, k=kind: change(t, k) if t else t)
        for o in (s or {}).get("observations") or []:
            for key in ("content", "output_summary", "error"):
                text(o, key, RESULT)
        for p in (s or {}).get("snippets") or []:
            text(p, "text", GENERAL)
    for key in ("description", "patch"):
        text(record.get("outcome"), key, GENERAL)
    text((record.get("environment") or {}).get("vcs"), "diff", GENERAL)
    return record


# Least density of identifiers, depth of paths and severity by level of sensitivity.
LEVELS = {"low": (0.02, 8, 2), "medium": (0.01, 6, 1), "high": (0.005, 4, 0)}
# Heuristics with severity (0 low, 1 medium, 2 high) and score.
HEURISTICS = [
    ("internal_hostname", 2, 0.6, re.compile(r"\b[a-z0-9][a-z0-9.-]*\.(?:internal|corp|local|intranet|lan)\b", re.I)),
    ("aws_account_id", 2, 0.7, re.compile(r"arn:aws[a-z-]*:[a-z0-9-]*:[a-z0-9-]*:[0-9]{12}")),
    ("db_connection_string", 2, 0.7, re.compile(r"\b(?:jdbc:[a-z0-9]+|mongodb\+srv)://[^\s\"']+", re.I)),
    ("internal_url", 1, 0.4, re.compile(r"https?://[^\s/\"']*(?:jira|confluence|wiki|gitlab|slack|sharepoint|notion)[^\s/\"']*/[^\s\"']*", re.I)),
]
_UUID = re.compile(r"\b[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}\b", re.I)
_HASH = re.compile(r"\b[0-9a-f]{32,64}\b", re.I)
_PATH = re.compile(r"(?:/[A-Za-z0-9_.-]+){2,}")


def classify(text: str | None, sensitivity: str = "medium") -> tuple[list[str], float]:
    """Names of the signals in a text (one for each hit) and the highest score, at a level of ``LEVELS`` (unknown: medium)."""
    if not text:
        return [], 0.0
    density_from, depth_from, least = LEVELS.get(sensitivity, LEVELS["medium"])
    flags: list[str] = []
    score = 0.0
    for name, severity, own, pattern in HEURISTICS:
        n = sum(1 for _ in pattern.finditer(text)) if severity >= least else 0
        flags += [name] * n
        score = max(score, own if n else 0.0)
    ids = len(_UUID.findall(text)) + len(_HASH.findall(text))
    density = ids / max(1, len(text.split()))
    if ids >= 3 and density >= density_from and least <= 1:
        flags.append("identifier_density")
        score = max(score, 0.3 + min(density * 10, 0.4))
    deep = sum(m[0].count("/") - 1 >= depth_from for m in _PATH.finditer(text)) if least == 0 else 0
    return flags + ["deep_file_path"] * deep, min(1.0, max(score, 0.2 if deep else 0.0))


def assess(record: dict, sensitivity: str = "medium") -> tuple[int, int, int, float, bool]:
    """(findings in the fields, in the serialized record, flags, risk, whether it is to be reviewed)."""
    n = [0, 0, 0.0]

    def look(text: str, kind: str) -> str:
        n[0] += len(findings(text, kind))
        flags, score = classify(text, sensitivity)
        n[1] += len(flags)
        n[2] = max(n[2], score)
        return text

    serialized = len(findings(json.dumps(record, ensure_ascii=False, default=str), GENERAL))
    visit(record, look)
    return n[0], serialized, n[1], round(n[2], 4), bool(n[0] or serialized)


def assessments(traces: DataFrame, sensitivity: str = "medium") -> DataFrame:
    """(row_id, n_findings, n_serialized, n_flags, risk, needs_review) of every record."""
    names = ["row_id", "n_findings", "n_serialized", "n_flags", "risk", "needs_review"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(r.pop("row_id"), *assess(r, sensitivity)) for r in b.to_pylist()]
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)

    return traces.mapInArrow(read, "row_id bigint, n_findings bigint, n_serialized bigint, n_flags bigint, risk double, needs_review boolean")


def redacted(traces: DataFrame) -> DataFrame:
    """The records as they came, without their findings; ``security`` is filled where the record has that struct.

    Same columns and types; redactions_applied counts the replaced places, scanned is true.
    """

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                n = [0]

                def change(text: str, kind: str, n=n) -> str:
                    new, k = redact(text, kind)
                    n[0] += k
                    return new

                r = visit(r, change)
                if isinstance(r.get("security"), dict):
                    r["security"] |= {k: v for k, v in (("scanned", True), ("redactions_applied", n[0])) if k in r["security"]}
                out.append(r)
            yield pa.RecordBatch.from_pylist(out, schema=b.schema)

    return traces.mapInArrow(clean, traces.schema)


def redacted_texts(traces: DataFrame, *columns: str) -> DataFrame:
    return redacted(traces).select("row_id", *columns)
