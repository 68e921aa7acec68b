"""Nested trace records to related flat tables (problem 2).

One higher-order projection per target table: nested ``transform`` calls attach
the ancestors' keys and positions, ``flatten`` joins the arrays of a record into
one, and a single ``inline`` emits its rows.  There is no shuffle and no join:
a record's rows are made where the record is read, so the plan is a scan, a
projection and a generator, and its cost is linear in the bytes of the columns
that it reads (nested column pruning drops the rest of the record).

Defined results
    * null or absent arrays and structs give no rows; a null element of an array
      is no call, observation or range, but keeps its position;
    * an id that is null or empty never links; repeated ids link to the first;
    * repeated records give their rows again, once per delivered ``row_id``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: rows of a table of the flattened record, in the order of the columns
STEP_COLS = ["row_id", "step_pos", "step_path", "step_index", "role", "call_type", "model", "parent_step", "parent_path", "content", "timestamp"]
CALL_COLS = ["row_id", "step_pos", "call_pos", "call_path", "parent_path", "tool_call_id", "tool_name", "input", "duration_ms"]
OBS_COLS = ["row_id", "step_pos", "obs_pos", "obs_path", "parent_path", "source_call_id", "content", "output_summary", "error"]
RANGE_COLS = ["row_id", "file_pos", "conv_pos", "range_pos", "range_path", "parent_path", "file_path", "url", "start_line", "end_line", "content_hash", "confidence"]


def _empty(kind: str) -> Column:
    return F.expr(f"CAST(array() AS array<{kind}>)")


def _text(c: Column) -> Column:
    return c.cast("string")


def _dot(*parts: Column) -> Column:
    return F.concat_ws(".", *[_text(p) for p in parts])


def _position(ids: Column, wanted: Column) -> Column:
    """0-based position of the first element equal to ``wanted``; null if there is none."""
    return F.nullif(F.array_position(ids, wanted), F.lit(0)) - 1


def _with(value: Column, f) -> Column:
    """``f`` of a value that is computed once for the record, also where ``f`` uses it inside lambdas."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _nested(outer: Column, f, kind: str) -> Column:
    """``flatten(transform(outer, f))`` that passes over null arrays."""
    return F.flatten(F.transform(outer, lambda x, i: F.coalesce(f(x, i), _empty(kind))))


def steps_table(traces: DataFrame) -> DataFrame:
    """One row per step, with the path of the step that its ``parent_step`` names ('' if none)."""
    rows = lambda idx: F.transform(
        "steps",
        lambda s, i: F.when(
            s.isNotNull(),
            F.struct(
                i.alias("step_pos"),
                _text(i).alias("step_path"),
                s["step_index"].alias("step_index"),
                s["role"].alias("role"),
                s["call_type"].alias("call_type"),
                s["model"].alias("model"),
                s["parent_step"].alias("parent_step"),
                F.coalesce(_text(_position(idx, s["parent_step"])), F.lit("")).alias("parent_path"),
                s["content"].alias("content"),
                s["timestamp"].alias("timestamp"),
            ),
        ),
    )
    return traces.select("row_id", F.inline(F.filter(_with(F.transform("steps", lambda s: s["step_index"]), rows), lambda r: r.isNotNull())))


def calls_table(traces: DataFrame) -> DataFrame:
    """One row per tool call; its parent is its step."""
    kind = "struct<step_pos:int,call_pos:int,call_path:string,parent_path:string,tool_call_id:string,tool_name:string,input:string,duration_ms:bigint>"

    def of_step(s: Column, i: Column) -> Column:
        return F.transform(
            s["tool_calls"],
            lambda c, j: F.when(
                c.isNotNull(),
                F.struct(
                    i.alias("step_pos"), j.alias("call_pos"), _dot(i, j).alias("call_path"), _text(i).alias("parent_path"),
                    c["tool_call_id"].alias("tool_call_id"), c["tool_name"].alias("tool_name"), c["input"].alias("input"), c["duration_ms"].alias("duration_ms"),
                ),
            ),
        )

    rows = _nested(F.col("steps"), of_step, kind)
    return traces.select("row_id", F.inline(F.filter(rows, lambda r: r.isNotNull())))


def observations_table(traces: DataFrame) -> DataFrame:
    """One row per observation; its parent is the first call of its step with its id ('' if none)."""
    kind = "struct<step_pos:int,obs_pos:int,obs_path:string,parent_path:string,source_call_id:string,content:string,output_summary:string,error:string>"

    def of_step(s: Column, i: Column) -> Column:
        ids = F.transform(s["tool_calls"], lambda c: c["tool_call_id"])
        return F.transform(
            s["observations"],
            lambda o, j: F.when(
                o.isNotNull(),
                F.struct(
                    i.alias("step_pos"), j.alias("obs_pos"), _dot(i, j).alias("obs_path"),
                    F.coalesce(F.concat(_text(i), F.lit("."), _text(_position(ids, F.nullif(o["source_call_id"], F.lit(""))))), F.lit("")).alias("parent_path"),
                    o["source_call_id"].alias("source_call_id"), o["content"].alias("content"), o["output_summary"].alias("output_summary"), o["error"].alias("error"),
                ),
            ),
        )

    rows = _nested(F.col("steps"), of_step, kind)
    return traces.select("row_id", F.inline(F.filter(rows, lambda r: r.isNotNull())))


def ranges_table(traces: DataFrame) -> DataFrame:
    """One row per attribution range; its parent is the first step that has the index at the end of the url."""
    inner = "struct<file_pos:int,conv_pos:int,range_pos:int,range_path:string,parent_path:string,file_path:string,url:string,start_line:bigint,end_line:bigint,content_hash:string,confidence:string>"

    def of_file(f: Column, i: Column, idx: Column) -> Column:
        def of_conv(c: Column, j: Column) -> Column:
            number = F.regexp_extract(c["url"], r"([0-9]+)\s*$", 1).try_cast("bigint")
            parent = F.coalesce(_text(_position(idx, number)), F.lit(""))
            return F.transform(
                c["ranges"],
                lambda r, k: F.when(
                    r.isNotNull(),
                    F.struct(
                        i.alias("file_pos"), j.alias("conv_pos"), k.alias("range_pos"), _dot(i, j, k).alias("range_path"), parent.alias("parent_path"),
                        f["path"].alias("file_path"), c["url"].alias("url"),
                        r["start_line"].alias("start_line"), r["end_line"].alias("end_line"), r["content_hash"].alias("content_hash"), r["confidence"].alias("confidence"),
                    ),
                ),
            )

        return _nested(f["conversations"], of_conv, inner)

    rows = _with(F.transform("steps", lambda s: s["step_index"]), lambda idx: _nested(F.col("attribution.files"), lambda f, i: of_file(f, i, idx), inner))
    return traces.select("row_id", F.inline(F.filter(rows, lambda r: r.isNotNull())))


def child_links(traces: DataFrame) -> DataFrame:
    """Every call, observation and range of a record with the path of its parent.

    All three kinds come from one projection and one ``inline``, so the table is
    read once.  Columns: row_id, child_kind, child_path, parent_path.
    """
    kind = "struct<child_kind:string,child_path:string,parent_path:string>"

    def link(name: str, child: Column, parent: Column) -> Column:
        return F.struct(F.lit(name).alias("child_kind"), child.alias("child_path"), parent.alias("parent_path"))

    def of_step(s: Column, i: Column) -> Column:
        ids = F.transform(s["tool_calls"], lambda c: c["tool_call_id"])
        calls = F.transform(s["tool_calls"], lambda c, j: F.when(c.isNotNull(), link("call", _dot(i, j), _text(i))))
        seen = F.transform(
            s["observations"],
            lambda o, j: F.when(
                o.isNotNull(),
                link("observation", _dot(i, j), F.coalesce(F.concat(_text(i), F.lit("."), _text(_position(ids, F.nullif(o["source_call_id"], F.lit(""))))), F.lit(""))),
            ),
        )
        return F.concat(F.coalesce(calls, _empty(kind)), F.coalesce(seen, _empty(kind)))


    def of_file(f: Column, i: Column, idx: Column) -> Column:
        def of_conv(c: Column, j: Column) -> Column:
            number = F.regexp_extract(c["url"], r"([0-9]+)\s*$", 1).try_cast("bigint")
            parent = F.coalesce(_text(_position(idx, number)), F.lit(""))
            return F.transform(c["ranges"], lambda r, k: F.when(r.isNotNull(), link("range", _dot(i, j, k), parent)))

        return _nested(f["conversations"], of_conv, kind)

    all_rows = F.concat(F.coalesce(_nested(F.col("steps"), of_step, kind), _empty(kind)), F.coalesce(_with(F.transform("steps", lambda s: s["step_index"]), lambda idx: _nested(F.col("attribution.files"), lambda f, i: of_file(f, i, idx), kind)), _empty(kind)))
    return traces.select("row_id", F.inline(F.filter(all_rows, lambda r: r.isNotNull())))
