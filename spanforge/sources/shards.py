"""Immutable JSON-lines shards: write, read, hash, card.

A push appends files and never rewrites them.  Reading takes the declared schema,
leaves bad lines out and fails on a missing or unreadable shard.
"""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanforge.functions.dialect import SPARK
from spanforge.operators.records import exchange_steps


def content_hash(df: DataFrame, exclude: tuple[str, ...] = ("content_hash", "trace_id", "row_id", "batch_no", "ingested_at")) -> Column:
    """SHA-256 of the record as JSON with its columns in the order of their names; null fields are left out."""
    return F.sha2(F.to_json(F.struct(*sorted(c for c in df.columns if c not in exclude))), 256)


def fresh(df: DataFrame, published: DataFrame) -> DataFrame:
    """Rows whose content hash is not among the published ones, one row per hash (the lowest row_id); rows without a hash are all new."""
    first = df.where(F.col("content_hash").isNotNull()).groupBy("content_hash").agg(F.min("row_id").alias("row_id"))
    known = published.select("content_hash").where(F.col("content_hash").isNotNull()).distinct()
    new = first.join(known, "content_hash", "left_anti").select("row_id")
    bare = df.where(F.col("content_hash").isNull()).select("row_id")
    return df.join(new.unionByName(bare).distinct(), "row_id", "left_semi")


def append(df: DataFrame, folder: str) -> None:
    """One push: new files in ``folder``; an empty batch is an error."""
    if df.isEmpty():
        raise ValueError("nothing to push")
    df.write.mode("append").json(folder)


def stage(records: DataFrame, folder: str) -> None:
    """Records waiting to be pushed, by the day they were staged; one table, not a file for each trace."""
    records.withColumn("staged_on", F.current_date()).write.mode("append").partitionBy("staged_on").json(f"{folder}/staging")


def write_sidecar(summary: DataFrame, folder: str) -> None:
    """The quality summary of a push beside its shards: a few rows in one file, replaced as a whole."""
    summary.coalesce(1).write.mode("overwrite").json(f"{folder}/quality")


def read_sidecar(spark: SparkSession, folder: str, schema: str) -> DataFrame | None:
    """The quality summary, or None if none was written."""
    try:
        return spark.read.schema(schema).json(f"{folder}/quality")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise


# What the exchange form keeps of a record.
COVERAGE = [
    ("steps[].content", "full"), ("steps[].reasoning_content", "full"), ("steps[].tool_calls", "full"), ("steps[].observations", "full"), ("steps[].model", "full"), ("steps[].role", "full"), ("agent", "full"),
    ("steps[].token_usage", "partial"), ("metrics", "partial"), ("task", "partial"), ("session_id", "full"), ("attribution", "dropped"), ("steps[].snippets", "dropped"), ("environment", "dropped"), ("outcome", "dropped"), ("security", "dropped"), ("dependencies", "dropped"),
]


def coverage(spark: SparkSession) -> DataFrame:
    """(path, kept): whether a field is kept in the exchange form in full, in part or not."""
    return spark.createDataFrame(COVERAGE, "path string, kept string")


def exchange(traces: DataFrame) -> DataFrame:
    """Records in the agent-trajectory exchange form; records without steps are left out."""
    usage = F.struct(F.col("metrics.total_input_tokens").alias("total_prompt_tokens"), F.col("metrics.total_output_tokens").alias("total_completion_tokens"), F.size("steps").cast("bigint").alias("total_steps"))
    agent = F.struct(F.coalesce("agent.name", F.lit("unknown")).alias("name"), F.col("agent.version").alias("version"), F.col("agent.model").alias("model_name"))
    return traces.where(F.size("steps") > 0).select(F.coalesce("session_id", "trace_id").alias("session_id"), agent.alias("agent"), F.expr(exchange_steps(SPARK)).alias("steps"), usage.alias("final_metrics"))


def export(traces: DataFrame, folder: str) -> None:
    """The exchange form as JSON lines, one record a line."""
    exchange(traces).write.mode("overwrite").json(folder)


def read(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    """All shards; lines that do not parse are left out."""
    marked = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
    rows = spark.read.schema(marked).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").option("ignoreMissingFiles", False).json(folder)
    return rows.where(F.col("_bad").isNull()).drop("_bad")


def features(schema: T.StructType) -> dict:
    """The declared feature schema as nested dicts."""

    def of(t: T.DataType):
        if isinstance(t, T.StructType):
            return {f.name: of(f.dataType) for f in t.fields}
        if isinstance(t, T.ArrayType):
            return [of(t.elementType)]
        if isinstance(t, T.MapType):
            return {"key": of(t.keyType), "value": of(t.valueType)}
        return {"long": "int64", "integer": "int64", "double": "float64", "boolean": "bool"}.get(t.typeName(), t.typeName())

    return of(schema)


def card(stats: dict, sections: dict[str, list[tuple]]) -> str:
    """Markdown card of one row of dataset statistics and small tables."""
    lines = ["---", f"size: {stats['n_traces']}", "---", "", "<!-- stats -->", "", "| measure | value |", "|---|---|"]
    lines += [f"| {k} | {v} |" for k, v in stats.items()]
    for name, rows in sections.items():
        lines += ["", f"## {name}", ""] + [f"- {' '.join(map(str, r))}" for r in rows]
    return "\n".join([*lines, "", "```json", json.dumps(stats, default=str, sort_keys=True), "```", "<!-- /stats -->", ""])


def replace_section(old: str, new: str) -> str:
    """``old`` with its marked section replaced by that of ``new``; the rest stays as written."""
    a, b = "<!-- stats -->", "<!-- /stats -->"
    if a not in old or b not in old:
        return new
    return old[: old.index(a)] + new[new.index(a) : new.index(b)] + old[old.index(b) :]
