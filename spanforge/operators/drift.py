"""Schemas that drift between files (problem 4).

Every file gets a schema fingerprint: the set of (path, type) of the fields that
at least a tenth of its records carry.  Fingerprints are compared along each
producer's files, differences become explicit migration steps (add, remove,
rename, retype), and the records of a file are then routed through its chained
steps - rename, default, cast - into one table with one set of fields.

Records are parsed where they are read; an Arrow batch is reduced to counts per
(file, path, type) before the shuffle, and of a line no more than a digest is
shuffled to find those that repeat, so a producer with a third of all records is
no larger in the counts than others with as many files.

Defined results
    * lines that are not one valid JSON object are left out (bodies_rejected has
      them); a line with the body of another line of the same file counts once;
    * a file without a valid record is passed over: the next file is compared
      with the one before it;
    * the type is that of most non-null values (ties: the field's earlier type,
      else the first by name); a field of nulls keeps its earlier type;
    * nulls in producer, file_name or file_seq make groups of their own.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from spanforge.session import cut

#: share of a file's records that must carry a field
MIN_SHARE = 0.1
#: a larger table is not broadcast but joined by its keys
BROADCAST_BYTES = 16 << 20


def _no_constant(name: str):
    raise ValueError(name)


_DECODE = json.JSONDecoder(parse_constant=_no_constant).decode


def parse_object(body: str | None) -> dict | None:
    """The JSON object in ``body``, or None if it holds no single valid object."""
    if not body:
        return None
    try:
        out = _DECODE(body)
    except (ValueError, RecursionError):
        return None
    return out if isinstance(out, dict) else None


def kind_of(v: object) -> str:
    """JSON type name of a value that is not an object."""
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "boolean"
    if isinstance(v, str):
        return "string"
    return "array" if isinstance(v, list) else "number"


def leaves(obj: dict) -> Iterator[tuple[str, object]]:
    """(dot-joined path, value) of every value that is not an object."""
    stack = [("", obj)]
    while stack:
        prefix, o = stack.pop()
        for k, v in o.items():
            if isinstance(v, dict):
                stack.append((f"{prefix}{k}.", v))
            else:
                yield prefix + k, v


_FILE = ["producer", "file_seq", "file_name"]


def _counted(lines: DataFrame, sign: int) -> DataFrame:
    """Counts per (producer, file_seq, file_name, path, kind) of every Arrow batch, times ``sign`` and the lines' ``times``."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            n: dict[tuple, int] = {}
            for producer, seq, name, body, times in zip(*(pdf[c] for c in (*_FILE, "body", "times")), strict=True):
                obj = parse_object(body)
                if obj is None:
                    continue
                file, times = (producer, None if pd.isna(seq) else int(seq), name), sign * times
                n[(file, "", "record")] = n.get((file, "", "record"), 0) + times
                for path, v in leaves(obj):
                    key = (file, path, kind_of(v))
                    n[key] = n.get(key, 0) + times
            yield pd.DataFrame([(*f, p, k, c) for (f, p, k), c in n.items()], columns=[*_FILE, "path", "kind", "n"]).astype({"file_seq": "Int64"})

    return lines.select(*_FILE, "body", "times").mapInPandas(count, "producer string, file_seq bigint, file_name string, path string, kind string, n bigint")


def field_counts(raw: DataFrame) -> DataFrame:
    """Counts per (producer, file_seq, file_name, path, kind) over the distinct lines of each file; path '' counts the records.

    Lines are parsed where they are read and only counts are shuffled.  What repeated lines add is taken off again:
    digests say which lines repeat, and only these, once each, are parsed a second time.
    """
    file = F.xxhash64(*[x for c in _FILE for x in (F.col(c), F.col(c).isNull())])
    lines = raw.where(F.col("body").isNotNull()).select("producer", F.col("file_seq").cast("bigint").alias("file_seq"), "file_name", "body")
    keyed = lines.withColumns({"_f": file, "_h": F.unhex(F.md5("body"))})
    again = cut(keyed.groupBy("_f", "_h").agg((F.count(F.lit(1)) - 1).alias("times")).where(F.col("times") > 0))
    out = _counted(lines.withColumn("times", F.lit(1).cast("bigint")), 1)
    if not again.isEmpty():
        small = again.count() * 40 <= BROADCAST_BYTES
        out = out.unionByName(_counted(keyed.join(F.broadcast(again) if small else again, ["_f", "_h"]).dropDuplicates(["_f", "_h"]), -1))
    return out.groupBy(*_FILE, "path", "kind").agg(F.sum("n").alias("n"))


def fingerprints(raw: DataFrame) -> DataFrame:
    """Fields per file: producer, file_no (1.. in a producer), file_seq, file_name, path, kind.

    ``kind`` is null for a field that was never anything but null.
    """
    counts = cut(field_counts(raw))
    per_path = counts.groupBy("producer", "file_seq", "file_name", "path").agg(
        F.sum("n").alias("n"),
        F.max(F.when(F.col("kind") != "null", F.col("n"))).alias("most"),
        F.collect_list(F.when(F.col("kind") != "null", F.struct("kind", "n"))).alias("kinds"),
    )
    files = per_path.where(F.col("path") == "").select("producer", "file_seq", "file_name", F.col("n").alias("n_records"))
    by_seq = W.Window.partitionBy("producer").orderBy(F.col("file_seq").asc_nulls_last(), "file_name")
    files = files.withColumn("file_no", F.row_number().over(by_seq)).withColumn("n_files", F.max("file_no").over(W.Window.partitionBy("producer")))
    had = per_path.where(F.col("path") != "").alias("p").join(
        files.alias("f"),
        F.col("p.producer").eqNullSafe(F.col("f.producer")) & F.col("p.file_seq").eqNullSafe(F.col("f.file_seq")) & F.col("p.file_name").eqNullSafe(F.col("f.file_name")),
    )
    had = had.where(F.col("p.n") >= MIN_SHARE * F.col("n_records")).select("f.producer", "f.file_no", "f.n_files", "f.file_seq", "f.file_name", "p.path", "p.most", "p.kinds")
    along = W.Window.partitionBy("producer", "path").orderBy("file_no")
    top = F.array_sort(F.transform(F.filter("kinds", lambda k: k["n"] == F.col("most")), lambda k: k["kind"]))
    had = had.withColumn("top", top).withColumn("one", F.when(F.size("top") >= 1, F.element_at("top", 1)))
    before = F.last("one", ignorenulls=True).over(along.rowsBetween(W.Window.unboundedPreceding, -1))
    had = had.withColumn("before", before)
    kind = F.when(F.array_contains("top", F.col("before")), F.col("before")).otherwise(F.coalesce("one", "before"))
    return had.select("producer", "file_no", "n_files", "file_seq", "file_name", "path", kind.alias("kind"))


def _name_key(path: str) -> str:
    return "".join(ch for ch in path.lower() if ch.isalnum())


def pair_renames(gone: list[tuple[str, str | None]], come: list[tuple[str, str | None]]) -> list[tuple[str, str]]:
    """Pairs (old, new) of the same type, the most alike names first.

    A field of nulls without a known type pairs only with a name much like its own.
    """
    scored = []
    for old, a in gone:
        for new, b in come:
            if a is not None and b is not None and a != b:
                continue
            ka, kb = _name_key(old), _name_key(new)
            tail = 1.0 if _name_key(old.rsplit(".", 1)[-1]) == _name_key(new.rsplit(".", 1)[-1]) else 0.0
            score = SequenceMatcher(None, ka, kb).ratio() + 0.3 * tail
            if (a is None or b is None) and score < 0.6:
                continue
            scored.append((-score, old, new))
    used_old, used_new, out = set(), set(), []
    for _, old, new in sorted(scored):
        if old not in used_old and new not in used_new:
            used_old.add(old)
            used_new.add(new)
            out.append((old, new))
    return out


def migration_steps(raw: DataFrame, fp: DataFrame | None = None) -> DataFrame:
    """Every change of a file against its producer's previous one.

    Columns producer, file_no, file_name, old_path, new_path, change_kind, kind.
    """
    fp = fp if fp is not None else cut(fingerprints(raw))
    along = W.Window.partitionBy("producer", "path").orderBy("file_no")
    w = fp.select("*", F.lag("file_no").over(along).alias("last_no"), F.lag("kind").over(along).alias("last_kind"), F.lead("file_no").over(along).alias("next_no"))
    names = fp.select("producer", "file_no", "file_name").distinct()
    came = w.where((F.col("file_no") > 1) & (F.coalesce("last_no", F.lit(0)) != F.col("file_no") - 1)).select("producer", "file_no", F.struct(F.lit("added").alias("what"), "path", "kind").alias("c"))
    went = w.where((F.col("file_no") < F.col("n_files")) & (F.coalesce("next_no", F.lit(0)) != F.col("file_no") + 1)).select(
        "producer", (F.col("file_no") + 1).alias("file_no"), F.struct(F.lit("removed").alias("what"), "path", "kind").alias("c")
    )
    turned = w.where((F.col("last_no") == F.col("file_no") - 1) & (F.col("kind") != F.col("last_kind"))).select(
        "producer", "file_no", F.struct(F.lit("retyped").alias("what"), "path", "kind").alias("c")
    )
    # a file has at most 10 fields for each field of its average record, so a group is small
    changes = came.unionByName(went).unionByName(turned).groupBy("producer", "file_no").agg(F.sort_array(F.collect_list("c")).alias("changes"))

    def settle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for producer, no, changes in zip(pdf["producer"], pdf["file_no"], pdf["changes"], strict=True):
                by: dict[str, list] = {"added": [], "removed": [], "retyped": []}
                for c in changes:
                    by[c["what"]].append((c["path"], c["kind"]))
                pairs = pair_renames(by["removed"], by["added"])
                old, new = {a for a, _ in pairs}, {b for _, b in pairs}
                kinds = dict(by["added"])
                out += [(producer, no, a, b, "renamed", kinds[b]) for a, b in pairs]
                out += [(producer, no, "", p, "added", k) for p, k in by["added"] if p not in new]
                out += [(producer, no, p, "", "removed", k) for p, k in by["removed"] if p not in old]
                out += [(producer, no, p, p, "retyped", k) for p, k in by["retyped"]]
            yield pd.DataFrame(out, columns=["producer", "file_no", "old_path", "new_path", "change_kind", "kind"])

    steps = changes.mapInPandas(settle, "producer string, file_no int, old_path string, new_path string, change_kind string, kind string").alias("s")
    return steps.join(names.alias("n"), F.col("s.producer").eqNullSafe(F.col("n.producer")) & (F.col("s.file_no") == F.col("n.file_no"))).select(
        "s.producer", "s.file_no", "n.file_name", "old_path", "new_path", "change_kind", "kind"
    )


#: the one set of fields and types that every file is read into
UNIFIED = [
    ("schema_version", "string"), ("trace_id", "string"), ("session_id", "string"), ("timestamp_start", "string"), ("timestamp_end", "string"), ("execution_context", "string"),
    ("task.description", "string"), ("task.source", "string"), ("task.repository", "string"), ("agent.name", "string"), ("agent.version", "string"), ("agent.model", "string"),
    ("environment.os", "string"), ("environment.shell", "string"), ("environment.vcs.branch", "string"), ("environment.language_ecosystem", "array"), ("dependencies", "array"),
    ("metrics.total_steps", "number"), ("metrics.total_input_tokens", "number"), ("metrics.total_output_tokens", "number"), ("metrics.total_duration_s", "number"), ("metrics.estimated_cost_usd", "number"),
    ("outcome.success", "boolean"), ("outcome.committed", "boolean"), ("outcome.commit_sha", "string"), ("security.scanned", "boolean"), ("security.flags_reviewed", "number"), ("security.classifier_version", "string"),
]
_SQL_TYPE = {"string": "string", "number": "double", "boolean": "boolean", "array": "array<string>"}


def _cast(v: object, kind: str) -> object:
    """Cast rules: a value that does not fit becomes null, never an error."""
    if v is None:
        return None
    if kind == "array":
        return [x if isinstance(x, str) else json.dumps(x) for x in v if x is not None] if isinstance(v, list) else [v if isinstance(v, str) else json.dumps(v)]
    if isinstance(v, list):  # a one-element array holds the value
        if len(v) != 1 or isinstance(v[0], (list, dict)):
            return json.dumps(v) if kind == "string" else None
        v = v[0]
        if v is None:
            return None
    if kind == "string":
        return v if isinstance(v, str) else json.dumps(v)
    if kind == "boolean":
        return v if isinstance(v, bool) else {"true": True, "false": False}.get(str(v).strip().lower())
    try:
        out = float(v) if not isinstance(v, bool) else float(int(v))
        return out if out - out == 0 else None
    except (TypeError, ValueError):
        return None


def follow(changes: list[tuple[int, str, str, str]]) -> list[tuple[str, int, int, str]]:
    """(path, from_no, to_no, name): under which name the paths of a producer's files are read, where it is not their own.

    ``changes`` are (file_no, old_path, new_path, change_kind).  A field keeps its identity through renames and ends
    when it is removed; a field that is added later under a free name is another one.  Its name is the one among its
    paths that ``UNIFIED`` has, else its first path; if two fields of one name live at the same time, the younger one
    gets the number of its first file behind it.
    """
    known = {p for p, _ in UNIFIED}
    born: list[tuple[int, list[str]]] = []  # identity: first file, paths
    ends: dict[int, float] = {}
    live: dict[str, tuple[int, int]] = {}  # path: identity, since which file
    spans: list[tuple[str, int, float, int]] = []

    def new(path: str, no: int) -> int:
        born.append((no, [path]))
        return len(born) - 1

    def leave(path: str, no: int) -> int:
        who, since = live.pop(path) if path in live else (new(path, 1), 1)
        spans.append((path, since, no, who))
        return who

    for no in sorted({c[0] for c in changes}):
        mine = [c for c in changes if c[0] == no]
        moved = {new_path: leave(old, no) for _, old, new_path, kind in mine if kind == "renamed"}
        for _, old, _, kind in mine:
            if kind == "removed":
                ends[leave(old, no)] = no
        for path, who in moved.items():
            born[who][1].append(path)
            live[path] = (who, no)
        for _, _, path, kind in mine:
            if kind == "added":
                live[path] = (new(path, no), no)
    spans += [(path, since, float("inf"), who) for path, (who, since) in live.items()]
    names: dict[int, str] = {}
    for who, (first, paths) in sorted(enumerate(born), key=lambda x: x[1][0]):
        name = next((p for p in paths if p in known), paths[0])
        clash = any(names[o] == name and ends.get(o, float("inf")) > first for o in names)
        names[who] = f"{name}__{first}" if clash else name
    return sorted((path, lo, 0 if hi == float("inf") else int(hi), names[who]) for path, lo, hi, who in spans if names[who] != path)


def routes(steps: DataFrame) -> DataFrame:
    """(producer, path, from_no, to_no, name): ``follow`` of every producer; to_no (exclusive) is 0 for fields that live on."""
    # the changes of a producer are as many as its schema changes, so they fit one row
    per = steps.where(F.col("change_kind") != "retyped").groupBy("producer").agg(F.sort_array(F.collect_list(F.struct("file_no", "old_path", "new_path", "change_kind"))).alias("c"))

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for producer, c in zip(pdf["producer"], pdf["c"], strict=True):
                out += [(producer, *r) for r in follow([(x["file_no"], x["old_path"], x["new_path"], x["change_kind"]) for x in c])]
            yield pd.DataFrame(out, columns=["producer", "path", "from_no", "to_no", "name"])

    return per.mapInPandas(each, "producer string, path string, from_no int, to_no int, name string")


def named_fields(fp: DataFrame, routed: DataFrame) -> DataFrame:
    """The fields of all files with the name that they are read under."""
    f, r = fp.alias("f"), routed.alias("r")
    on = F.col("f.producer").eqNullSafe(F.col("r.producer")) & (F.col("f.path") == F.col("r.path")) & (F.col("f.file_no") >= F.col("r.from_no")) & ((F.col("r.to_no") == 0) | (F.col("f.file_no") < F.col("r.to_no")))
    return f.join(r, on, "left").select("f.*", F.coalesce("r.name", "f.path").alias("name"))


def regular_fields(named: DataFrame) -> tuple[dict[str, str], dict[str, str]]:
    """Types by name of the fields outside ``UNIFIED``, and the name for each ``_name_key``.

    Spellings that differ in case and signs only are one field, named by ``UNIFIED``, else as most files do.
    Only fields that a tenth of a file's records carry get here, so both are small.
    """
    files: dict[str, dict[str, int]] = {}
    kinds: dict[str, dict[str, int]] = {}
    for r in named.groupBy("name", "kind").count().collect():
        key = _name_key(r["name"]) or r["name"]
        files.setdefault(key, {})[r["name"]] = files.get(key, {}).get(r["name"], 0) + r["count"]
        if r["kind"]:
            kinds.setdefault(key, {})[r["kind"]] = kinds.get(key, {}).get(r["kind"], 0) + r["count"]
    names = {key: min(n, key=lambda x: (-n[x], x)) for key, n in files.items()} | {_name_key(p): p for p, _ in UNIFIED}
    known = dict(UNIFIED)
    types = {names[key]: min(k, key=lambda x: (-k[x], x)) if (k := kinds.get(key)) else "string" for key in files}
    return {n: k for n, k in sorted(types.items()) if n not in known}, names


def rules(raw: DataFrame) -> DataFrame:
    """The rules that each file's records are routed through: producer, file_no, file_name, rule, path, name, kind.

    ``rename``: the path is read as ``name``; ``cast``: its values have another type in this file than the table's
    ``kind``; ``default``: the file lacks a field that the producer's other files have, so it is null there.
    """
    fp = cut(fingerprints(raw))
    named = cut(named_fields(fp, routes(migration_steps(raw, fp))))
    more, names = regular_fields(named)
    typed = dict(UNIFIED) | more
    dim = raw.sparkSession.createDataFrame([(n, names.get(_name_key(n) or n, n)) for n in {r["name"] for r in named.select("name").distinct().collect()}], "name string, target string")
    kinds = raw.sparkSession.createDataFrame(list(typed.items()), "target string, to string")
    all_of = named.join(dim, "name").join(kinds, "target", "left")
    out = all_of.select("producer", "file_no", "file_name", F.explode(F.array_compact(F.array(
        F.when(F.col("path") != F.col("target"), F.lit("rename")), F.when(F.col("kind") != F.col("to"), F.lit("cast"))))).alias("rule"), "path", F.col("target").alias("name"), F.col("to").alias("kind"))
    ever = all_of.select("producer", "target", "to").distinct()
    files = named.select("producer", "file_no", "file_name").distinct()
    j = files.alias("x").join(ever.alias("e"), F.col("x.producer").eqNullSafe(F.col("e.producer"))).select("x.producer", "file_no", "file_name", "target", "to").alias("j")
    has = all_of.select("producer", "file_no", "target").distinct().alias("h")
    lacks = j.join(has, F.col("j.producer").eqNullSafe(F.col("h.producer")) & (F.col("j.file_no") == F.col("h.file_no")) & (F.col("j.target") == F.col("h.target")), "left_anti")
    return out.unionByName(lacks.select("producer", "file_no", "file_name", F.lit("default").alias("rule"), F.lit("").alias("path"), F.col("target").alias("name"), F.col("to").alias("kind")))


def unify(raw: DataFrame) -> DataFrame:
    """All valid records in one table: producer, file_name, line_no, the fields of
    ``UNIFIED`` and all regular fields of the files (dots written as ``__``), and
    ``extra``, a JSON object of the fields outside ``UNIFIED``, one-off ones too,
    under the same names and casts.

    Each record goes through the rules of its own file: renames by ``routes``, then defaults (null) and casts.  The
    routes of a producer are one short text; they are broadcast up to ``BROADCAST_BYTES`` in all, else joined.
    """
    fp = cut(fingerprints(raw))
    routed = cut(routes(migration_steps(raw, fp)))
    more, names = regular_fields(named_fields(fp, routed))
    taken = {"producer", "file_name", "line_no", "extra"} | {p.replace(".", "__").lower() for p, _ in UNIFIED}
    fields = list(UNIFIED)
    for p, k in more.items():
        if p.replace(".", "__").lower() not in taken:
            taken.add(p.replace(".", "__").lower())
            fields.append((p, k))
    files = fp.select("producer", "file_no", "file_seq", "file_name").distinct()
    lo, hi = files.alias("lo"), files.alias("hi")
    r = routed.alias("r")
    r = r.join(lo, F.col("r.producer").eqNullSafe(F.col("lo.producer")) & (F.col("r.from_no") == F.col("lo.file_no")))
    r = r.join(hi, F.col("r.producer").eqNullSafe(F.col("hi.producer")) & (F.col("r.to_no") == F.col("hi.file_no")), "left")
    one = F.struct("r.path", "r.name", F.col("lo.file_seq").alias("seq"), F.col("lo.file_name").alias("file"), (F.col("r.to_no") > 0).alias("ends"), F.col("hi.file_seq").alias("end_seq"), F.col("hi.file_name").alias("end_file"))
    events = cut(r.groupBy("r.producer").agg(F.to_json(F.sort_array(F.collect_list(one))).alias("routes")))
    size = events.agg(F.sum(F.length("routes"))).first()[0] or 0
    src = raw.select("producer", "file_name", "line_no", F.col("file_seq").cast("bigint").alias("file_seq"), "body").alias("r")
    src = src.join((F.broadcast(events) if size <= BROADCAST_BYTES else events).alias("n"), F.col("r.producer").eqNullSafe(F.col("n.producer")), "left").select("r.*", "n.routes")
    known, typed = dict(UNIFIED), dict(UNIFIED) | more

    def place(seq, file) -> tuple:
        return (float("inf") if seq is None or pd.isna(seq) else int(seq), file or "")

    def read_routes(text: str) -> dict[str, list[tuple]]:
        out: dict[str, list[tuple]] = {}
        for x in json.loads(text):
            end = place(x.get("end_seq"), x.get("end_file")) if x["ends"] else (float("inf"), "\U0010ffff")
            out.setdefault(x["path"], []).append((place(x.get("seq"), x.get("file")), end, x["name"]))
        return out

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known_routes: dict[str, dict] = {}
        for pdf in batches:
            cols: dict[str, list] = {p: [] for p, _ in fields}
            keep, extras = [], []
            for i, (body, text, seq, file) in enumerate(zip(pdf["body"], pdf["routes"], pdf["file_seq"], pdf["file_name"], strict=True)):
                obj = parse_object(body)
                if obj is None:
                    continue
                keep.append(i)
                own: dict[str, list[tuple]] = {}
                if text:
                    if text not in known_routes:
                        if len(known_routes) > 1000:
                            known_routes.clear()
                        known_routes[text] = read_routes(text)
                    own = known_routes[text]
                here = place(seq, file)
                rec, extra = {}, {}
                for path, v in leaves(obj):
                    to = next((name for lo, hi, name in own[path] if lo <= here < hi), path) if path in own else path
                    to = names.get(_name_key(to) or to, to) if to not in known else to
                    value = _cast(v, typed[to]) if to in typed else v
                    if rec.get(to) is None:
                        rec[to] = value
                    if to not in known and extra.get(to) is None:
                        extra[to] = value
                for p in cols:
                    cols[p].append(rec.get(p))
                extras.append(json.dumps(extra, sort_keys=True) if extra else None)
            out = pdf.iloc[keep][["producer", "file_name", "line_no"]].reset_index(drop=True)
            made = {p.replace(".", "__"): pd.Series(cols[p], dtype="float64" if k == "number" else "object") for p, k in fields}
            yield pd.concat([out, pd.DataFrame({**made, "extra": pd.Series(extras, dtype="object")})], axis=1)

    quoted = lambda p: "`" + p.replace(".", "__").replace("`", "``") + "`"
    schema = "producer string, file_name string, line_no bigint, " + ", ".join(f"{quoted(p)} {_SQL_TYPE[k]}" for p, k in fields) + ", extra string"
    return src.withColumn("line_no", F.col("line_no").cast("bigint")).mapInPandas(read, schema)
