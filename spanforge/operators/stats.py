"""Statistics over traces, their staging state and metric snapshots.

All groupings are on low-cardinality keys or are pre-aggregated; top-k reports
sort the aggregated table, never the rows.  Ties break by name.  Null groups are
kept under 'unknown' where a report names them, else as a null group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W


def dataset_card(traces: DataFrame) -> DataFrame:
    """One row: traces, steps, tokens, first and last day, mean steps, success rate, cost."""
    days = F.array(F.left("timestamp_start", F.lit(10)), F.left("timestamp_end", F.lit(10)))
    t = traces.select(
        F.coalesce(F.nullif(F.col("metrics.total_steps"), F.lit(0)), F.size("steps").cast("bigint"), F.lit(0)).alias("steps"),
        (F.coalesce("metrics.total_input_tokens", F.lit(0)) + F.coalesce("metrics.total_output_tokens", F.lit(0))).alias("tokens"),
        F.array_min(F.array_compact(days)).alias("lo"), F.array_max(F.array_compact(days)).alias("hi"),
        F.col("outcome.success").cast("double").alias("success"), F.col("metrics.estimated_cost_usd").alias("cost"),
    )
    return t.agg(
        F.count(F.lit(1)).alias("n_traces"), F.sum("steps").alias("total_steps"), F.sum("tokens").alias("total_tokens"), F.min("lo").alias("first_day"), F.max("hi").alias("last_day"),
        F.bround(F.avg("steps"), 0).alias("avg_steps"), F.bround(F.avg("success") * 100, 1).alias("success_rate"), F.bround(F.avg("cost"), 2).alias("avg_cost"), F.bround(F.sum("cost"), 2).alias("total_cost"),
    )


def histogram(df: DataFrame, c: Column, name: str) -> DataFrame:
    """Counts by value, null as 'unknown'."""
    return df.groupBy(F.coalesce(c, F.lit("unknown")).alias(name)).agg(F.count(F.lit(1)).alias("n"))


def top_k(df: DataFrame, name: str, k: int) -> DataFrame:
    """The k most frequent values; ties by name."""
    return df.orderBy(F.col("n").desc(), F.col(name).asc()).limit(k)


def top_dependencies(traces: DataFrame, k: int = 10) -> DataFrame:
    """Dependencies of most traces, without shell tokens and one-letter names."""
    one = traces.select(F.explode(F.array_distinct("dependencies")).alias("dependency")).where((F.length("dependency") > 1) & ~F.col("dependency").rlike(r"^[&|;<>!]+$"))
    return top_k(histogram(one, F.col("dependency"), "dependency"), "dependency", k)


def latest_state(state: DataFrame) -> DataFrame:
    """The last state of a trace by created_at (nulls first, ties by status), its status in one spelling."""
    s = state.select("trace_id", F.lower(F.trim("status")).alias("status"), "created_at", "uploaded_at", "error")
    w = W.Window.partitionBy("trace_id").orderBy(F.col("created_at").desc_nulls_last(), F.col("status").desc_nulls_last(), F.col("uploaded_at").desc_nulls_last(), F.col("error").desc_nulls_last())
    return s.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1).drop("_r")


def stage_counts(traces: DataFrame, state: DataFrame) -> DataFrame:
    """Distinct traces per status; traces without a state are 'inbox'."""
    ids = traces.where(F.col("trace_id").isNotNull()).select("trace_id").distinct()
    return ids.join(latest_state(state), "trace_id", "left").groupBy(F.coalesce("status", F.lit("inbox")).alias("status")).agg(F.count(F.lit(1)).alias("n"))


def uploads_by_day(state: DataFrame) -> DataFrame:
    """Uploaded entries per day of uploaded_at, else of created_at."""
    day = F.coalesce(F.left("uploaded_at", F.lit(10)), F.date_format(F.timestamp_seconds(F.floor("created_at")), "yyyy-MM-dd"))
    return state.where(F.lower(F.trim("status")) == "uploaded").groupBy(day.alias("day")).agg(F.count(F.lit(1)).alias("n"))


def macro_average(traces: DataFrame) -> DataFrame:
    """Mean of the repositories' mean steps, beside the mean over all traces."""
    per = traces.groupBy(F.col("task.repository").alias("repository")).agg(F.avg(F.coalesce(F.size("steps"), F.lit(0))).alias("m"), F.count(F.lit(1)).alias("n"))
    return per.agg(F.count(F.lit(1)).alias("n_groups"), F.bround(F.avg("m"), 4).alias("macro_avg"), F.bround(F.sum(F.col("m") * F.col("n")) / F.sum("n"), 4).alias("micro_avg"))


def rollup(traces: DataFrame) -> DataFrame:
    """Traces, tokens and success by agent and overall (null agent: all)."""
    t = traces.select(F.coalesce("agent.name", F.lit("unknown")).alias("agent"), F.coalesce("metrics.total_input_tokens", F.lit(0)).alias("tokens"), F.col("outcome.success").cast("double").alias("ok"))
    return t.rollup("agent").agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("tokens"), F.bround(F.avg("ok"), 4).alias("success_rate"))


def tool_stats(traces: DataFrame) -> DataFrame:
    """Per tool: calls, calls in error, success rate; the error is that of the first observation of the call in its step."""
    err = F.expr(
        "inline(flatten(transform(steps, s -> coalesce(transform(s.tool_calls, c -> named_struct('tool', coalesce(c.tool_name, 'unknown'), "
        "'error', get(filter(coalesce(s.observations, array()), o -> o.source_call_id = c.tool_call_id), 0).error)), "
        "CAST(array() AS array<struct<tool:string,error:string>>)))))"
    )
    return traces.select(err).groupBy("tool").agg(F.count(F.lit(1)).alias("n"), F.count("error").alias("n_errors"), F.bround(1 - F.count("error") / F.count(F.lit(1)), 3).alias("success_rate"))


def new_hashes(traces: DataFrame) -> DataFrame:
    """Per batch the rows whose content hash no earlier batch holds, and those known.

    One pass: the first batch of each hash is a minimum, so no history is joined.
    Hashes are compared without case and ``sha256:``; missing or filler hashes are new.
    """
    h = F.regexp_replace(F.lower(F.trim("content_hash")), "^sha256:", "")
    ok = h.rlike("^[0-9a-f]{64}$") & ~h.rlike("^(.)\\1{63}$")
    keyed = traces.select("batch_no", F.when(ok, h).alias("h"))
    first = keyed.where(F.col("h").isNotNull()).groupBy("h").agg(F.min("batch_no").alias("first_batch"))
    # rows without a hash stay out of the join; equal hashes of a batch are one row of it
    per = keyed.where(F.col("h").isNotNull()).groupBy("batch_no", "h").agg(F.count(F.lit(1)).alias("n"))
    joined = per.join(first, "h").select("batch_no", "n", F.when(F.col("first_batch") < F.col("batch_no"), F.col("n")).otherwise(0).alias("known"))
    bare = keyed.where(F.col("h").isNull()).groupBy("batch_no").agg(F.count(F.lit(1)).alias("n"), F.lit(0).cast("bigint").alias("known"))
    return joined.unionByName(bare).groupBy("batch_no").agg(F.sum("n").alias("n_rows"), F.sum("known").alias("n_known"))


def snapshots(events: DataFrame) -> DataFrame:
    """Metric snapshots made of events: project, metric, day bucket, value, as_of."""
    return events.select(F.col("user_id").alias("project"), F.col("event_type").alias("metric"), F.date_format("ts", "yyyy-MM-dd").alias("bucket"), F.col("value"), F.col("ts").alias("as_of"), "event_id")


def latest_snapshot(snaps: DataFrame) -> DataFrame:
    """The last value per project and metric (by as_of, then event_id); a mergeable maximum, no sort."""
    last = F.max_by(F.struct("value", "as_of", "bucket"), F.struct("as_of", "event_id"))
    return snaps.groupBy("project", "metric").agg(last.alias("l")).select("project", "metric", "l.value", "l.as_of", "l.bucket")


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """One row per (project, metric, bucket): the last written wins, new rows over old ones."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    last = F.max_by(F.struct("value", "as_of"), F.struct("_new", "as_of", "event_id"))
    return both.groupBy("project", "metric", "bucket").agg(last.alias("l")).select("project", "metric", "bucket", "l.value", "l.as_of")


def series(snaps: DataFrame, days: int) -> DataFrame:
    """Sum per metric and day over the last ``days`` days of the data."""
    end = snaps.agg(F.max("as_of").alias("end"))
    recent = snaps.join(F.broadcast(end), F.col("as_of") > F.col("end") - F.make_dt_interval(F.lit(days)))  # one row
    return recent.groupBy("metric", "bucket").agg(F.bround(F.sum("value"), 4).alias("value"), F.count(F.lit(1)).alias("n"))


def freshness(snaps: DataFrame, limit_minutes: int = 240) -> DataFrame:
    """Per metric the last as_of and whether it is at most ``limit_minutes`` behind the newest of all."""
    per = snaps.groupBy("metric").agg(F.max("as_of").alias("last_as_of"))
    newest = W.Window.partitionBy(F.lit(1))  # one row per metric
    lag = (F.unix_micros(F.max(F.col("last_as_of").cast("timestamp")).over(newest)) - F.unix_micros(F.col("last_as_of").cast("timestamp"))) / 60_000_000
    return per.withColumn("behind_minutes", F.floor(lag)).withColumn("fresh", F.col("behind_minutes") <= limit_minutes)


#: width of the cells that a user's events are cut into, so that a busy user is spread over tasks
CELL_US = 3_600_000_000


def _cells(events: DataFrame) -> DataFrame:
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return events.select("event_id", "user_id", "event_type", "value", us.alias("us"), F.floor(us / CELL_US).alias("cell"))


def timeline(events: DataFrame) -> DataFrame:
    """Per event its offset from the first of the session and the sum of values before it.

    Sums run over cells of time first (one row per user and cell), then inside a cell.
    """
    e = _cells(events)
    per = e.groupBy("user_id", "cell").agg(F.sum("value").alias("s"), F.min("us").alias("lo"))
    along = W.Window.partitionBy("user_id").orderBy("cell")
    per = per.select("user_id", "cell", F.coalesce(F.sum("s").over(along.rowsBetween(W.Window.unboundedPreceding, -1)), F.lit(0.0)).alias("s0"), F.min("lo").over(W.Window.partitionBy("user_id")).alias("start"))
    inside = W.Window.partitionBy("user_id", "cell").orderBy("us", "event_id").rowsBetween(W.Window.unboundedPreceding, -1)
    j = e.join(per, ["user_id", "cell"]).withColumn("inner", F.coalesce(F.sum("value").over(inside), F.lit(0.0)))
    return j.select("event_id", F.bround((F.col("us") - F.col("start")) / 1_000_000, 3).alias("offset_s"), F.bround(F.col("s0") + F.col("inner"), 2).alias("value_before"))


def recent_k(events: DataFrame, k: int = 5) -> DataFrame:
    """The k most recent events of each user."""
    w = W.Window.partitionBy("user_id").orderBy(F.col("ts").desc(), F.col("event_id").desc())
    return events.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("user_id", "event_id", "rank")


def first_last(events: DataFrame) -> DataFrame:
    return events.groupBy("user_id").agg(F.min_by("event_type", F.struct("ts", "event_id")).alias("first_type"), F.max_by("event_type", F.struct("ts", "event_id")).alias("last_type"), F.count(F.lit(1)).alias("n"))


def alternation(events: DataFrame) -> DataFrame:
    """Per user the share of neighbouring events of different type (1 for fewer than two); neighbours across cells meet by the cells' ends."""
    e = _cells(events)
    inside = W.Window.partitionBy("user_id", "cell").orderBy("us", "event_id")
    same = e.select("user_id", (F.lag("event_type").over(inside) == F.col("event_type")).cast("int").alias("same"))
    ends = e.groupBy("user_id", "cell").agg(F.min_by("event_type", F.struct("us", "event_id")).alias("first"), F.max_by("event_type", F.struct("us", "event_id")).alias("last"))
    joints = ends.select("user_id", (F.lag("last").over(W.Window.partitionBy("user_id").orderBy("cell")) == F.col("first")).cast("int").alias("same"))
    return same.unionByName(joints).groupBy("user_id").agg(F.coalesce(F.bround(1 - F.sum("same") / F.count("same"), 4), F.lit(1.0)).alias("ratio"))


def interval_commits(sessions: DataFrame, commits: DataFrame, width_us: int = 6 * 3_600_000_000) -> DataFrame:
    """The last commit within each session: (session_id, commit_id, n).

    A range join as an equi-join on time buckets: a session is copied to each
    bucket that it touches (a few), a commit goes to its own, so both sides are
    partitioned by bucket and nothing is crossed.  Expects ``repo`` on both sides,
    start_us and end_us, at_us; sessions that end before they start hold nothing.
    """
    s = sessions.where(F.col("end_us") >= F.col("start_us")).withColumn("bucket", F.explode(F.sequence(F.floor(F.col("start_us") / width_us), F.floor(F.col("end_us") / width_us))))
    c = commits.withColumn("bucket", F.floor(F.col("at_us") / width_us))
    hit = s.join(c, ["repo", "bucket"]).where(F.col("at_us").between(F.col("start_us"), F.col("end_us")))
    return hit.groupBy("session_id").agg(F.max_by("commit_id", F.struct("at_us", "commit_id")).alias("commit_id"), F.count(F.lit(1)).alias("n_commits"))


def step_tree(traces: DataFrame) -> DataFrame:
    """(row_id, step_pos, root_pos, depth): the step hierarchy of every record.

    A step's parent is the first step that has its ``parent_step`` as index.  The tree is resolved inside the record
    by doubling pointers, log2(n) times over its array, so nothing is shuffled; steps whose pointers never reach a
    root (those of a cycle and below it) and orphans are roots themselves.
    """
    up = "transform(steps, (s, i) -> nullif(nullif(array_position(transform(steps, x -> x.step_index), s.parent_step), 0) - 1, CAST(i AS bigint)))"
    t = traces.where("size(steps) > 0").selectExpr("row_id", f"transform({up}, u -> CAST(u AS int)) AS up")
    start = "named_struct('at', transform(up, (u, i) -> coalesce(u, i)), 'd', transform(up, u -> if(u IS NULL, 0, 1)))"
    twice = "named_struct('at', transform(acc.at, a -> get(acc.at, a)), 'd', transform(acc.at, (a, i) -> get(acc.d, i) + get(acc.d, a)))"
    t = t.selectExpr("row_id", "up", f"aggregate(sequence(1, CAST(ceil(log2(size(up) + 1)) AS int) + 1), {start}, (acc, k) -> {twice}) AS w")
    rows = "transform(w.at, (a, i) -> named_struct('step_pos', i, 'root_pos', if(get(up, a) IS NULL, a, i), 'depth', if(get(up, a) IS NULL, get(w.d, i), 0)))"
    return t.selectExpr("row_id", f"inline({rows})")
