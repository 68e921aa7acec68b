"""Reports and merges over records, batches and series.

Per-record projections do not shuffle; rollups are on few keys; sorted reports sort aggregated rows only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Order of the stages of staging.
STAGES = ("inbox", "committed", "pushed", "uploaded", "rejected", "failed")
CUT = "... (truncated)"


def detail(traces: DataFrame, row_ids: list[int], limit: int = 500) -> DataFrame:
    """Steps of the given records as a reader sees them: texts of more than ``limit`` characters end in a mark."""
    shown = lambda t: F.when(F.length(t) > limit, F.concat(F.left(t, F.lit(limit)), F.lit(CUT))).otherwise(t)
    s = traces.where(F.col("row_id").isin(row_ids)).select("row_id", F.posexplode("steps").alias("pos", "s"))
    return s.select("row_id", "pos", F.col("s.role").alias("role"), shown(F.col("s.content")).alias("content"), F.coalesce(F.size("s.tool_calls"), F.lit(0)).alias("n_calls"))


def judge_summary(traces: DataFrame) -> DataFrame:
    """What a judge is shown of a record: the task cut at 500 characters, counts of steps by role, up to five tools, up to 20 dependencies and ten attributed files."""
    names = F.flatten(F.filter(F.transform("steps", lambda s: F.transform(s["tool_calls"], lambda c: c["tool_name"])), lambda x: x.isNotNull()))
    n = lambda role: F.coalesce(F.size(F.filter("steps", lambda s: s["role"] == role)), F.lit(0))
    head = lambda a, k: F.array_join(F.slice(F.array_sort(F.array_distinct(F.array_compact(a))), 1, k), ",")
    return traces.select(
        "row_id", F.left("task.description", F.lit(500)).alias("task"), n("user").alias("n_user"), n("agent").alias("n_agent"), F.coalesce(F.size(names), F.lit(0)).alias("n_calls"), head(names, 5).alias("tools"),
        head(F.col("dependencies"), 20).alias("packages"), head(F.transform("attribution.files", lambda f: f["path"]), 10).alias("files"),
    )


def unattributed(traces: DataFrame) -> DataFrame:
    """Files that a record's diff changes but its attribution does not name, sorted, joined by commas."""
    named = F.transform(F.coalesce("attribution.files", F.expr("CAST(array() AS array<struct<path:string>>)")), lambda f: F.coalesce(f["path"], F.lit("")))
    changed = F.regexp_extract_all(F.coalesce("environment.vcs.diff", F.lit("")), F.lit(r"(?m)^[+]{3} b/([^\r\n\t]+)"), F.lit(1))
    return traces.select("row_id", F.array_join(F.array_sort(F.array_except(changed, named)), ",").alias("files"))


def conversations_of_edits(ranges: DataFrame) -> DataFrame:
    """Attribution as files with one conversation per step that edited them: row_id, file_path, url, n_ranges, first_line, last_line.

    ``ranges``(row_id, file_path, step_pos, start_line, end_line); the url names the step.
    """
    url = F.concat(F.lit("spanforge://trace/step_"), F.col("step_pos").cast("string"))
    return ranges.groupBy("row_id", "file_path", "step_pos").agg(F.count(F.lit(1)).alias("n_ranges"), F.min("start_line").alias("first_line"), F.max("end_line").alias("last_line")).select("row_id", "file_path", url.alias("url"), "n_ranges", "first_line", "last_line")


def fill_when_empty(own: Column, derived: Column) -> Column:
    """An array that is there, else the derived one."""
    return F.when(F.coalesce(F.size(own), F.lit(0)) > 0, own).otherwise(derived)


def merge_commit(outcome: Column, committed: Column, sha: Column, patch: Column) -> Column:
    """An outcome with a commit's fields; what an environment reported of reward and end stays."""
    yes = F.coalesce(committed, F.lit(False))
    out = outcome
    for field, value in (("committed", F.lit(True)), ("commit_sha", sha), ("patch", patch), ("success", F.lit(True)), ("signal_source", F.lit("deterministic")), ("signal_confidence", F.lit("derived"))):
        keep = outcome["reward"].isNotNull() if field in ("success", "signal_source", "signal_confidence") else F.lit(False)
        out = out.withField(field, F.when(yes & ~keep, F.coalesce(value, outcome[field])).otherwise(outcome[field]))
    return F.coalesce(out, outcome)


def hybrid(scores: DataFrame, judged: DataFrame) -> DataFrame:
    """0.6 of the checks' score and 0.4 of the judge's, where there is one."""
    j = scores.join(judged, ["row_id", "persona"], "left")
    return j.select("row_id", "persona", F.bround(F.when(F.col("judge_score").isNull(), F.col("total_score")).otherwise(0.6 * F.col("total_score") + 0.4 * F.col("judge_score")), 1).alias("score"))


def badge(score: Column) -> Column:
    return F.when(score >= 80, "good").when(score >= 60, "fair").when(score >= 40, "weak").otherwise("poor")


def compare_batches(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Mean per persona here, there, and their difference (null without a counterpart)."""
    return local.select("persona", F.col("avg_score").alias("here")).join(remote.select("persona", F.col("avg_score").alias("there")), "persona", "left").withColumn("delta", F.bround(F.col("here") - F.col("there"), 1))


def series_totals(snaps: DataFrame, days: int = 365) -> DataFrame:
    """Per metric the sum of all points, that of the last ``days`` days of the data, and the number of days."""
    end = snaps.agg(F.max("as_of").alias("end"))
    recent = F.when(F.col("as_of") > F.col("end") - F.make_dt_interval(F.lit(days)), F.col("value"))
    return snaps.crossJoin(F.broadcast(end)).groupBy("metric").agg(F.bround(F.sum("value"), 2).alias("total"), F.bround(F.sum(recent), 2).alias("recent"), F.countDistinct("bucket").alias("n_days"))  # the other side is one row


def rows_per_project(snaps: DataFrame) -> DataFrame:
    return snaps.groupBy("project").agg(F.count(F.lit(1)).alias("n"))


def by_stage(stages: DataFrame) -> DataFrame:
    """Counts by stage with the stage's place in the order; unknown stages come last."""
    at = F.array_position(F.array(*[F.lit(s) for s in STAGES]), F.col("status"))
    return stages.withColumn("place", F.when(at == 0, len(STAGES) + 1).otherwise(at).cast("int")).orderBy("place", "status")


def largest_first(counts: DataFrame, name: str, n: str = "n") -> DataFrame:
    """Rows by a count, nulls as 0; ties by name."""
    return counts.withColumn(n, F.coalesce(n, F.lit(0))).orderBy(F.col(n).desc(), F.col(name).asc_nulls_last())


def tagged(rows: DataFrame, tag: str, tags: str, name: str) -> DataFrame:
    """Rows that carry a tag or whose name holds it, without regard to case."""
    return rows.where(F.coalesce(F.array_contains(F.transform(tags, F.lower), tag.lower()), F.lit(False)) | F.coalesce(F.contains(F.lower(name), F.lit(tag.lower())), F.lit(False)))


def commit_groups(traces: DataFrame) -> DataFrame:
    """One group per batch: its different traces, first and last row."""
    return traces.groupBy("batch_no").agg(F.countDistinct("trace_id").alias("n_traces"), F.min("row_id").alias("first_row"), F.max("row_id").alias("last_row"))


def union_distinct(a: DataFrame, b: DataFrame, key: str, order: str) -> DataFrame:
    """Rows of both tables, one per key: that of the highest ``order`` (a mergeable maximum); rows without a key stay."""
    both = a.unionByName(b)
    rest = [c for c in both.columns if c != key]
    one = both.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("l")).select(key, "l.*")
    return one.unionByName(both.where(F.col(key).isNull()).select(key, *rest))
