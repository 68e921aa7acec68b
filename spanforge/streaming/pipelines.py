"""Structured Streaming pipelines: incremental ingest, deduplication, upsert, sessions.

All state has a bound: watermarks drop what is older, keyed state expires by
timer, sinks are idempotent per batch id, and checkpoints live in the shared
folder that the session names, so a query survives the loss of executors.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from spanforge.session import shared_dir


def place(spark: SparkSession, name: str) -> str:
    """A new folder for a query's checkpoint and output."""
    return f"{shared_dir(spark).rstrip('/')}/streams/{name}-{uuid.uuid4().hex}"


def landed(spark: SparkSession, glob: str, schema: T.StructType | str, per_trigger: int = 64) -> DataFrame:
    """Immutable landed Parquet files as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(glob)


def drain(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Everything there is now, through the stream, into Parquet files."""
    spark = stream.sparkSession
    folder = place(spark, name)
    q = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def deduplicated(stream: DataFrame, keys: list[str], time: str = "ts", late: str = "30 days") -> DataFrame:
    """The first of each key within the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def publish_new(stream: DataFrame, keys: list[str], folder: str) -> None:
    """Adds the rows whose keys no earlier batch published, one row per key (the first by its columns' order).

    The stream's own state only has to cover its horizon; what came before it is found among what is published.
    A batch that is run again overwrites its own folder and is compared with the others.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        rest = [c for c in batch.columns if c not in keys]
        one = batch.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("l")).select(*keys, "l.*")
        try:
            old = batch.sparkSession.read.parquet(f"{folder}/table").where(F.col("batch") != batch_id).select(*keys)
            one = one.join(old.distinct(), keys, "left_anti")
        except AnalysisException as e:  # nothing published so far
            if "PATH_NOT_FOUND" not in str(e):
                raise
        one.write.mode("overwrite").parquet(f"{folder}/table/batch={batch_id}")

    q = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()


def daily(stream: DataFrame, time: str = "ts", late: str = "2 days") -> DataFrame:
    """Tumbling daily counts and sums per event type."""
    w = F.window(time, "1 day")
    return stream.withWatermark(time, late).groupBy(w, "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value")).select(F.col("window.start").alias("day"), "event_type", "n", "value")


def session_windows(stream: DataFrame, gap: str = "30 minutes", time: str = "ts", late: str = "2 hours") -> DataFrame:
    """Sessions of a user by gaps between events."""
    w = F.session_window(time, gap)
    return stream.withWatermark(time, late).groupBy(w, "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def upsert_stream(stream: DataFrame, keys: list[str], order: list[str], folder: str) -> None:
    """Last write wins per key: each batch adds its own last rows as one file set, readers take the last of all.

    A batch that is run again overwrites its own folder, so the sink is idempotent.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        rest = [c for c in batch.columns if c not in keys]
        last = F.max_by(F.struct(*rest), F.struct(*order))
        batch.groupBy(*keys).agg(last.alias("l")).select(*keys, "l.*").write.mode("overwrite").parquet(f"{folder}/table/batch={batch_id}")

    q = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()


def read_upserted(spark: SparkSession, keys: list[str], order: list[str], folder: str) -> DataFrame:
    t = spark.read.parquet(f"{folder}/table").drop("batch")
    rest = [c for c in t.columns if c not in keys]
    return t.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("l")).select(*keys, "l.*")


CLOSED = "session_id string, n_events bigint, first_ts timestamp, last_ts timestamp, closed_by string"


def close_sessions(stream: DataFrame, idle_ms: int = 1_800_000, late: str = "10 minutes") -> DataFrame:
    """Sessions closed by their Stop event, or by event time passing ``idle_ms`` beyond their last one.

    Expects session_id, ts and event.  The state of a session is three values.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        cols = ["session_id", "n_events", "first_ts", "last_ts", "closed_by"]
        n, lo, hi = state.get if state.exists else (0, None, None)
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([(key[0], n, pd.Timestamp(lo, unit="us"), pd.Timestamp(hi, unit="us"), "idle")], columns=cols)
            return
        stopped = False
        for pdf in batches:
            us = pdf["ts"].astype("datetime64[us]").astype("int64")
            n += len(pdf)
            lo = int(us.min()) if lo is None else min(lo, int(us.min()))
            hi = int(us.max()) if hi is None else max(hi, int(us.max()))
            stopped |= bool((pdf["event"] == "Stop").any())
        if stopped:
            if state.exists:
                state.remove()
            yield pd.DataFrame([(key[0], n, pd.Timestamp(lo, unit="us"), pd.Timestamp(hi, unit="us"), "stop")], columns=cols)
        elif n:
            state.update((n, lo, hi))
            state.setTimeoutTimestamp(max(hi // 1000 + idle_ms, state.getCurrentWatermarkMs() + 1))

    marked = stream.select("session_id", "ts", "event").withWatermark("ts", late)
    return marked.groupBy("session_id").applyInPandasWithState(step, CLOSED, "n bigint, lo bigint, hi bigint", "append", GroupStateTimeout.EventTimeTimeout)


def new_files(listing: DataFrame, ledger: DataFrame) -> DataFrame:
    """Files to be read: unknown inodes from the start, known ones that are newer from their offset.

    ``listing``(file_path, inode, mtime, size), ``ledger``(file_path, inode, mtime, last_byte_offset).
    A file that shrank is read from the start.
    """
    j = listing.alias("n").join(ledger.alias("o"), F.col("n.file_path") == F.col("o.file_path"), "left")
    same = F.col("n.inode") == F.col("o.inode")
    grown = same & (F.col("n.mtime") > F.col("o.mtime"))
    start = F.when(grown & (F.col("n.size") >= F.col("o.last_byte_offset")), F.col("o.last_byte_offset")).otherwise(0)
    return j.where(F.col("o.file_path").isNull() | ~F.coalesce(same, F.lit(False)) | grown).select("n.file_path", "n.inode", "n.mtime", "n.size", start.alias("from_offset"))


def merge_lines(old: DataFrame, new: DataFrame) -> DataFrame:
    """Lines of growing files, one per (file, line_no); what was read last holds."""
    both = old.withColumn("_o", F.lit(0)).unionByName(new.withColumn("_o", F.lit(1)))
    return both.groupBy("file", "line_no").agg(F.max_by("raw", "_o").alias("raw"))
