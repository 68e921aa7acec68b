"""Queries of the sources and streaming pipelines, over transcripts made of the trace table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.sources import conversations, shards, transcripts
from spanforge.sources.tables import table
from spanforge.streaming import pipelines

Query = Callable[[SparkSession, str], DataFrame]

_SCHEMA = (
    "row_id bigint, session_id string, steps array<struct<step_index:bigint, role:string, content:string, model:string, timestamp:string, tool_calls:array<struct<tool_call_id:string, tool_name:string, input:string>>, "
    "observations:array<struct<source_call_id:string, content:string, error:string>>, token_usage:struct<input_tokens:bigint, output_tokens:bigint, cache_read_tokens:bigint>>>"
)


def event_lines(traces: DataFrame) -> DataFrame:
    """(file, line_no, raw): each step as one event line, its observations as the next."""
    s = traces.select(F.col("row_id").cast("string").alias("file"), "session_id", F.posexplode("steps").alias("pos", "s"))
    agent = F.col("s.role") == "agent"
    text = F.struct(F.lit("text").alias("type"), F.coalesce("s.content", F.lit("")).alias("text"), *[F.lit(None).cast("string").alias(c) for c in ("id", "name", "input", "tool_use_id", "content")])
    nul = F.lit(None).cast("string")
    uses = F.transform(
        F.coalesce("s.tool_calls", F.array()),
        lambda c: F.struct(F.lit("tool_use").alias("type"), nul.alias("text"), c["tool_call_id"].alias("id"), c["tool_name"].alias("name"), c["input"].alias("input"), nul.alias("tool_use_id"), nul.alias("content")),
    )
    got = F.transform(
        F.coalesce("s.observations", F.array()),
        lambda o: F.struct(F.lit("tool_result").alias("type"), nul.alias("text"), nul.alias("id"), nul.alias("name"), nul.alias("input"), o["source_call_id"].alias("tool_use_id"), o["content"].alias("content")),
    )
    usage = F.struct(F.col("s.token_usage.input_tokens").alias("input_tokens"), F.col("s.token_usage.output_tokens").alias("output_tokens"), F.col("s.token_usage.cache_read_tokens").alias("cache_read_input_tokens"))
    said = F.struct(
        F.when(agent, "assistant").otherwise("user").alias("type"), F.col("session_id").alias("sessionId"), F.col("s.timestamp").alias("timestamp"),
        F.struct(F.col("s.role").alias("role"), F.col("s.model").alias("model"), F.concat(F.array(text), uses).alias("content"), usage.alias("usage")).alias("message"),
    )
    back = F.struct(F.lit("user").alias("type"), F.col("session_id").alias("sessionId"), F.struct(F.lit("user").alias("role"), got.alias("content")).alias("message"))
    first = s.select("file", (F.col("pos") * 2).alias("line_no"), F.to_json(said).alias("raw"))
    return first.unionByName(s.where(F.size(got) > 0).select("file", (F.col("pos") * 2 + 1).alias("line_no"), F.to_json(back).alias("raw")))


def transcript_counters(s: SparkSession, d: str) -> DataFrame:
    parsed = transcripts.events(event_lines(table(s, d, "traces", _SCHEMA)))
    return transcripts.raw_counters(parsed).select("file", "lines", "corrupt_lines", "user_messages", "assistant_messages", "tool_uses", "tool_results", "with_timestamp")


def transcript_steps(s: SparkSession, d: str) -> DataFrame:
    parsed = transcripts.events(event_lines(table(s, d, "traces", _SCHEMA)))
    own = transcripts.steps(transcripts.messages(parsed)).select("file", "line_no", "role", "content", "model", "timestamp", F.coalesce(F.size("tool_calls"), F.lit(0)).alias("n_calls"))
    return own


def transcript_sessions(s: SparkSession, d: str) -> DataFrame:
    return transcripts.sessions(transcripts.events(event_lines(table(s, d, "traces", _SCHEMA)))).select("file", "session_id", "model", "timestamp_start", "timestamp_end", "n_events")


def transcript_preservation(s: SparkSession, d: str) -> DataFrame:
    parsed = transcripts.events(event_lines(table(s, d, "traces", _SCHEMA)))
    return transcripts.preservation(transcripts.raw_counters(parsed), transcripts.steps(transcripts.messages(parsed)))


def conversation_steps(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "traces", "row_id bigint, steps array<struct<role:string, content:string>>")
    rows = t.select("row_id", F.transform("steps", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("conversations"))
    out = conversations.conversation_steps(rows.select(F.col("row_id").alias("row_key"), "conversations"))
    return out.select("row_key", "step_index", "role", "content")


def publish_fresh(s: SparkSession, d: str) -> DataFrame:
    """Rows of the last batch whose content is not in earlier batches."""
    t = table(s, d, "traces", "row_id bigint, batch_no bigint, content_hash string")
    last = t.agg(F.max("batch_no").alias("last"))
    both = t.join(F.broadcast(last), F.lit(True))  # one row
    new, old = both.where(F.col("batch_no") == F.col("last")), both.where(F.col("batch_no") < F.col("last"))
    return shards.fresh(new.select("row_id", "content_hash"), old).select("row_id", "content_hash")


_EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def _events(s: SparkSession, d: str) -> DataFrame:
    return pipelines.landed(s, f"{d}/events*.parquet", _EVENTS).withColumn("ts", F.col("ts").cast("timestamp"))


def stream_dedup(s: SparkSession, d: str) -> DataFrame:
    folder = pipelines.place(s, "dedup")
    pipelines.publish_new(pipelines.deduplicated(_events(s, d), ["event_id"], late="7 days"), ["event_id"], folder)
    return s.read.schema(f"{_EVENTS}, batch int").parquet(f"{folder}/table").select("event_id", "user_id", "event_type", "value")


def stream_upsert(s: SparkSession, d: str) -> DataFrame:
    snaps = _events(s, d).select(F.col("user_id").alias("project"), F.col("event_type").alias("metric"), "value", F.col("ts").alias("as_of"), "event_id")
    folder = pipelines.place(s, "upsert")
    pipelines.upsert_stream(snaps, ["project", "metric"], ["as_of", "event_id"], folder)
    return pipelines.read_upserted(s, ["project", "metric"], ["as_of", "event_id"], folder).select("project", "metric", "value")


QUERIES: dict[str, Query] = {f.__name__: f for f in (transcript_counters, transcript_steps, transcript_sessions, transcript_preservation, conversation_steps, publish_fresh, stream_dedup, stream_upsert)}

_S = "SELECT row_id::VARCHAR AS file, session_id, i - 1 AS pos, steps[i] AS s FROM (SELECT row_id, session_id, steps, unnest(range(1, len(steps) + 1)) AS i FROM traces)"
ORACLE: dict[str, str] = {
    "transcript_counters": f"""SELECT file, (count(*) + count(*) FILTER (len(s.observations) > 0))::BIGINT AS lines, 0::BIGINT AS corrupt_lines,
 (count(*) FILTER (coalesce(s.role, '') <> 'agent') + count(*) FILTER (len(s.observations) > 0))::BIGINT AS user_messages, count(*) FILTER (s.role = 'agent') AS assistant_messages,
 sum(coalesce(len(s.tool_calls), 0))::BIGINT AS tool_uses, sum(coalesce(len(s.observations), 0))::BIGINT AS tool_results, count(s.timestamp) AS with_timestamp FROM ({_S}) GROUP BY file""",
    "transcript_steps": f"SELECT file, (pos * 2)::INT AS line_no, CASE WHEN s.role = 'agent' THEN 'agent' ELSE 'user' END AS role, coalesce(s.content, '') AS content, s.model, s.timestamp, coalesce(len(s.tool_calls), 0)::INT AS n_calls FROM ({_S})",
    "transcript_sessions": f"""SELECT file, min(session_id) AS session_id, arg_min(s.model, pos) FILTER (s.model IS NOT NULL) AS model, arg_min(s.timestamp, pos) FILTER (s.timestamp IS NOT NULL) AS timestamp_start,
 arg_max(s.timestamp, pos) FILTER (s.timestamp IS NOT NULL) AS timestamp_end, (count(*) + count(*) FILTER (len(s.observations) > 0))::BIGINT AS n_events FROM ({_S}) GROUP BY file""",
    "publish_fresh": """WITH m AS (SELECT max(batch_no) AS b FROM traces) SELECT min(row_id) AS row_id, content_hash FROM traces, m WHERE batch_no = b AND content_hash IS NOT NULL
 AND content_hash NOT IN (SELECT content_hash FROM traces, m WHERE batch_no < b AND content_hash IS NOT NULL) GROUP BY content_hash
 UNION ALL SELECT DISTINCT row_id, content_hash FROM traces, m WHERE batch_no = b AND content_hash IS NULL""",
    "stream_dedup": "SELECT event_id, user_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY ts) = 1",
    "stream_upsert": "SELECT user_id AS project, event_type AS metric, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1",
}
