"""Conversation datasets (JSON lines or Parquet) to trace records.

Rows are remapped, folded to steps (see ``conversations``) and projected to records.  An import fails as a whole if
more than ``MAX_ERRORS`` of at least ``LEAST`` rows cannot be read; rows without a conversation are skipped and not
counted as errors.

Defined results: null rows and rows without turns are skipped; a model is named only if the row names one; a session's
id is made of dataset, subset, revision and row, so reading a dataset again gives the same ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from spanforge.session import cut
from spanforge.sources.conversations import conversation_steps, success_rate

MAX_ERRORS, LEAST = 0.10, 10
ROW = (
    "conversations array<struct<role:string, content:string, `from`:string, value:string>>, metadata struct<model:string, timestamp:string>, source_row struct<original_prompt:string, task_source:string>, "
    "usage struct<prompt_tokens:bigint, completion_tokens:bigint, estimated_cost_usd:double>, completed boolean, partial boolean, "
    "tool_stats map<string, struct<count:bigint, success:bigint, failure:bigint>>, task string, tools string, category string, subcategory string, id string"
)


class ImportFailed(ValueError):
    """Too many rows of a dataset could not be read."""


def read_rows(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a dataset of JSON lines with their place in it (``row_index``, also as text ``row_key``) and whether they could be read (``bad``).

    Places are counted by the parts that the files are read in, so no row is sorted or moved.
    """
    lines = spark.read.text(path, recursiveFileLookup=True).where(F.trim("value") != "").withColumn("m", F.monotonically_increasing_id())
    e = F.from_json("value", f"{ROW}, _bad string", {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"})
    rows = cut(lines.withColumn("e", e).select("m", F.shiftright("m", 33).alias("part"), (F.col("e").isNull() | F.col("e._bad").isNotNull()).alias("bad"), "e.*").drop("_bad"))
    before = W.Window.orderBy("part").rowsBetween(W.Window.unboundedPreceding, -1)  # one row a part
    start = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    index = F.col("start") + F.col("m").bitwiseAND(F.lit((1 << 33) - 1))
    return rows.join(start, "part").withColumn("row_index", index).withColumn("row_key", index.cast("string")).drop("m", "part", "start")


def checked(rows: DataFrame) -> DataFrame:
    """The readable rows that hold a conversation; raises ``ImportFailed`` where too many rows are bad."""
    held = F.size(F.coalesce("conversations", F.array())) > 0
    n = rows.agg(F.count_if(F.col("bad")).alias("bad"), F.count_if(~F.col("bad") & held).alias("good")).first()
    if n.bad + n.good >= LEAST and n.bad / (n.bad + n.good) > MAX_ERRORS:
        raise ImportFailed(f"{n.bad} of {n.bad + n.good} rows cannot be read")
    return rows.where(~F.col("bad") & held)


def remap(rows: DataFrame, model: str | None = None) -> DataFrame:
    """Fields of other dataset layouts in their place: task as prompt, a given model, the turns' from and value, tools as text or list."""
    turn = lambda t: F.struct(F.coalesce(t["role"], t["from"]).alias("role"), F.coalesce(t["content"], t["value"]).alias("content"))
    return rows.withColumns(
        {
            "conversations": F.transform("conversations", turn),
            "prompt": F.coalesce("source_row.original_prompt", "task"),
            "model": F.coalesce(F.nullif(F.col("metadata.model"), F.lit("")), F.lit(model)),
            "tool_definitions": F.from_json("tools", "array<string>"),
        }
    )


def outcome(completed: Column, partial: Column, reward: Column) -> Column:
    """What a run's outcome is known from: an environment's reward, else the source's own statement."""
    by_reward, done = reward.isNotNull(), (completed & ~F.coalesce(partial, F.lit(False)))
    state = F.when(reward > 0, "goal_reached").when(reward < 0, "error").when(by_reward, "abandoned").when(done, "goal_reached").when(~completed, "abandoned").when(partial, "interrupted")
    return F.struct(
        F.when(by_reward, reward > 0).when(done, True).when(~completed, False).alias("success"),
        F.when(by_reward, "rl_environment").when(done | ~completed, "source_metadata").alias("signal_source"),
        F.when(by_reward, "derived").when(done | ~completed, "inferred").otherwise("derived").alias("signal_confidence"),
        state.alias("terminal_state"), reward.alias("reward"), F.when(by_reward, "rl_environment").alias("reward_source"),
    )


def reward_of(steps: Column) -> Column:
    """The last reward that an observation of a results call reports."""
    calls = F.flatten(F.transform(steps, lambda s: F.transform(F.filter(s["calls"], lambda c: c["tool_name"] == "rl_get_results"), lambda c: c["tool_call_id"])))
    seen = F.flatten(F.transform(steps, lambda s: F.transform(F.filter(s["observations"], lambda o: F.array_contains(calls, o["source_call_id"])), lambda o: F.get_json_object(o["content"], "$.reward").try_cast("double"))))
    return F.try_element_at(F.filter(seen, lambda r: r.isNotNull()), F.lit(-1))


def records(rows: DataFrame, dataset: str, subset: str = "default", revision: str = "unknown", split: str = "train") -> DataFrame:
    """One record per row of ``remap``; expects ``row_key`` and ``row_index``."""
    steps = conversation_steps(rows, "row_key").groupBy(F.col("row_key").alias("k")).agg(F.array_sort(F.collect_list(F.struct("step_index", "role", "content", "reasoning_content", "system_prompt_hash", "calls", "observations", "n_malformed"))).alias("steps"))
    j = rows.join(steps, F.col("row_key") == F.col("k")).drop("k")
    index = F.col("row_index").cast("string")
    bad = lambda s: s["n_malformed"] + F.size(F.filter(s["observations"], lambda o: F.coalesce(o["error"] == "unlinked_response", F.lit(False))))
    meta = F.struct(
        F.lit(dataset).alias("source_dataset"), F.lit(revision).alias("source_dataset_revision"), F.lit(subset).alias("source_subset"), F.lit(split).alias("source_split"), F.col("row_index").alias("source_row_index"),
        F.lit("conversation_turn").alias("step_fidelity"), F.struct("completed", "partial").alias("source_completion_status"), success_rate(F.col("tool_stats")).alias("tool_success_rate"),
        F.nullif(F.aggregate("steps", F.lit(0), lambda a, s: a + bad(s)), F.lit(0)).alias("linkage_failures"), F.col("category").alias("source_category"), F.col("subcategory").alias("source_subcategory"), F.col("id").alias("source_row_id"),
    )
    with_model = F.transform("steps", lambda s: F.struct(s["step_index"].alias("step_index"), s["role"].alias("role"), s["content"].alias("content"), s["reasoning_content"].alias("reasoning_content"), F.when(s["role"] == "agent", F.col("model")).alias("model"), s["system_prompt_hash"].alias("system_prompt_hash"), s["calls"].alias("tool_calls"), s["observations"].alias("observations")))
    j = j.withColumns({"_reward": reward_of(F.col("steps")), "_n": F.size("steps").cast("bigint"), "_meta": F.to_json(meta), "_steps": with_model})
    return j.select(
        F.concat_ws(":", F.lit(dataset), F.lit(subset), F.lit(revision[:12]), index).alias("session_id"), F.lit("runtime").alias("execution_context"),
        F.struct(F.col("prompt").alias("description"), F.col("source_row.task_source").alias("source")).alias("task"), F.struct(F.col("model").alias("model")).alias("agent"), F.col("_steps").alias("steps"),
        F.struct(F.col("_n").alias("total_steps"), F.coalesce("usage.prompt_tokens", F.lit(0)).alias("total_input_tokens"), F.coalesce("usage.completion_tokens", F.lit(0)).alias("total_output_tokens"), F.nullif(F.col("usage.estimated_cost_usd"), F.lit(0.0)).alias("estimated_cost_usd")).alias("metrics"),
        outcome(F.col("completed"), F.col("partial"), F.col("_reward")).alias("outcome"), F.col("metadata.timestamp").alias("timestamp_start"), "tool_definitions", F.col("_meta").alias("metadata"),
    )


def load(spark: SparkSession, path: str, dataset: str, model: str | None = None, **source: str) -> DataFrame:
    """Records of the JSON lines under ``path``."""
    return records(remap(checked(read_rows(spark, path)), model), dataset, **source)


#: names of the readers and writers of this package, by kind of source
REGISTRY = {"transcript": "spanforge.sources.transcripts:parse", "conversations": "spanforge.sources.datasets:load", "shards": "spanforge.sources.shards:read", "manifests": "spanforge.sources.manifests:dependencies", "exchange": "spanforge.sources.shards:append"}


def adapter(name: str):
    """The reader or writer registered under a name; KeyError names those there are."""
    import importlib

    if name not in REGISTRY:
        raise KeyError(f"{name!r} is none of {sorted(REGISTRY)}")
    module, _, function = REGISTRY[name].partition(":")
    return getattr(importlib.import_module(module), function)
