"""Readers of the engine's Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: The parts of a trace record that single operators need.  Lambdas over nested
#: arrays keep Catalyst from pruning nested fields, so the reader is told.
LINK_SCHEMA = (
    "row_id bigint, steps array<struct<step_index:bigint, tool_calls:array<struct<tool_call_id:string>>, observations:array<struct<source_call_id:string>>>>, "
    "attribution struct<files:array<struct<conversations:array<struct<url:string, ranges:array<struct<start_line:bigint>>>>>>>"
)
CONTENT_SCHEMA = "row_id bigint, batch_no bigint, steps array<struct<content:string>>"
TEXT_SCHEMA = (
    "row_id bigint, session_id string, task struct<description:string, repository:string>, environment struct<vcs:struct<diff:string>>, "
    "steps array<struct<tool_calls:array<struct<input:string>>, observations:array<struct<content:string>>>>"
)


def table(spark: SparkSession, folder: str, name: str, schema: str | None = None) -> DataFrame:
    """``<folder>/<name>.parquet``; a file or a folder of part files.

    ``schema`` names the (nested) columns to be read; others stay on disk.
    """
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(f"{folder}/{name}.parquet")


def _keep(t: T.DataType, paths: list[str]) -> T.DataType:
    if isinstance(t, T.ArrayType):
        return T.ArrayType(_keep(t.elementType, paths), t.containsNull)
    if not isinstance(t, T.StructType) or "" in paths:
        return t
    fields = []
    for f in t.fields:
        inner = [p.partition(".")[2] for p in paths if p.partition(".")[0] == f.name]
        if inner:
            fields.append(T.StructField(f.name, _keep(f.dataType, inner), f.nullable))
    return T.StructType(fields)


def pick(spark: SparkSession, folder: str, name: str, paths: str) -> DataFrame:
    """A table with no more than the given dotted paths (separated by blanks); a path to a struct takes all of it."""
    whole = table(spark, folder, name)
    return spark.read.schema(_keep(whole.schema, paths.split())).parquet(f"{folder}/{name}.parquet")
