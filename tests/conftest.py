from __future__ import annotations

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]

DATA = os.environ.get("SPANFORGE_TESTDATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from spanforge.session import build_session

    s = build_session("tests", "local[4]", shuffle=4)
    s.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoint")))
    yield s
    s.stop()


@pytest.fixture(scope="session")
def data():
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    return DATA


TRACE = (
    "row_id bigint, batch_no bigint, schema_version string, trace_id string, session_id string, content_hash string, timestamp_start string, timestamp_end string, execution_context string, "
    "task struct<description:string, source:string, repository:string, base_commit:string>, agent struct<name:string, version:string, model:string>, "
    "environment struct<os:string, shell:string, vcs:struct<type:string, base_commit:string, branch:string, diff:string>, language_ecosystem:array<string>>, system_prompts map<string,string>, tool_definitions array<string>, "
    "steps array<struct<step_index:bigint, role:string, content:string, reasoning_content:string, model:string, system_prompt_hash:string, agent_role:string, parent_step:bigint, call_type:string, subagent_trajectory_ref:string, "
    "tools_available:array<string>, tool_calls:array<struct<tool_call_id:string, tool_name:string, input:string, duration_ms:bigint>>, observations:array<struct<source_call_id:string, content:string, output_summary:string, error:string>>, "
    "snippets:array<struct<file_path:string, start_line:bigint, end_line:bigint, language:string, text:string, source_step:bigint>>, "
    "token_usage:struct<input_tokens:bigint, output_tokens:bigint, cache_read_tokens:bigint, cache_write_tokens:bigint, prefix_reuse_tokens:bigint>, timestamp:string>>, "
    "outcome struct<success:boolean, signal_source:string, signal_confidence:string, description:string, patch:string, committed:boolean, commit_sha:string, terminal_state:string, reward:double, reward_source:string>, dependencies array<string>, "
    "metrics struct<total_steps:bigint, total_input_tokens:bigint, total_output_tokens:bigint, total_duration_s:double, cache_hit_rate:double, estimated_cost_usd:double>, "
    "security struct<scanned:boolean, flags_reviewed:bigint, redactions_applied:bigint, classifier_version:string>, "
    "attribution struct<experimental:boolean, files:array<struct<path:string, conversations:array<struct<contributor:map<string,string>, url:string, ranges:array<struct<start_line:bigint, end_line:bigint, content_hash:string, confidence:string>>>>>>>, metadata string"
)


@pytest.fixture(scope="session")
def make_traces(spark):
    """DataFrame of records given as dicts; absent fields are null, two extra columns have names used inside the operators."""
    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    schema = T._parse_datatype_string(TRACE)

    def fill(t, v):
        if v is None:
            return None
        if isinstance(t, T.StructType):
            return tuple(fill(f.dataType, v.get(f.name)) for f in t.fields)
        if isinstance(t, T.ArrayType):
            return [fill(t.elementType, x) for x in v]
        return v

    def make(records: list[dict]):
        df = spark.createDataFrame([fill(schema, r) for r in records], schema)
        return df.withColumn("n", F.lit(7)).withColumn("text", F.lit("clash")).withColumn("path", F.lit("clash")).withColumn("words", F.lit("clash"))

    return make
