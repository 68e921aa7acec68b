"""Display projections, filters and small rollups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.functions.dialect import SPARK, Dialect


def clean(d: Dialect, x: str) -> str:
    """Text without tags, entities and control marks, white space collapsed."""
    return f"trim({d.replace(d.replace(d.replace(f'coalesce({x}, ' + chr(39) * 2 + ')', '<[^<>]{1,200}>', ' '), '&[a-z]{2,6};', ' '), '[ \\t\\r\\n]+', ' ')})"


def first_line(d: Dialect, x: str) -> str:
    """The first line with a letter or digit, at most 80 characters."""
    lines = d.filter(d.split(f"coalesce({x}, '')", "\\n"), "l", d.matches("l", "[A-Za-z0-9]"))
    return f"left(coalesce(trim({d.at(lines, '0')}), ''), 80)"


def primary_argument(d: Dialect, name: str, arg: str) -> str:
    """What a call is about: the file's name, the command, the pattern or the address, at most 50 characters."""
    get = (lambda k: f"coalesce({d.json(arg, k)}, '')") if d.spark else (lambda k: f"coalesce(CASE WHEN json_valid({arg}) THEN {d.json(arg, k)} END, '')")
    base = d.extract(get("file_path"), "([^/]+)$", 1)
    return f"left(CASE {name} WHEN 'Read' THEN {base} WHEN 'Write' THEN {base} WHEN 'Edit' THEN {base} WHEN 'Bash' THEN {d.extract(get('command'), '^([^' + chr(92) + 'n]*)', 1)} WHEN 'Grep' THEN {get('pattern')} WHEN 'Glob' THEN {get('pattern')} WHEN 'WebFetch' THEN {get('url')} ELSE '' END, 50)"


def short_model(d: Dialect, x: str) -> str:
    """A model's name without provider and date."""
    return d.replace(d.replace(x, "^[a-z]+/", ""), "-[0-9]{8}$", "")


def readable(d: Dialect, n: str) -> str:
    """A count as 999, 1.2K, 3.4M."""
    text = "string" if d.spark else "VARCHAR"
    return f"CASE WHEN {n} >= 1000000 THEN concat(CAST({d.round(f'{n} / CAST(1000000 AS double)', 1)} AS {text}), 'M') WHEN {n} >= 1000 THEN concat(CAST({d.round(f'{n} / CAST(1000 AS double)', 1)} AS {text}), 'K') ELSE CAST({n} AS {text}) END"


def session_view(d: Dialect) -> dict[str, str]:
    return {"title": first_line(d, "task.description"), "cleaned": clean(d, "task.description"), "model": short_model(d, "coalesce(agent.model, '')"), "tokens": readable(d, "coalesce(metrics.total_input_tokens, 0)")}


def consumer_filter(traces: DataFrame, excluded: list[str] | None = None, agent: str | None = None, model_part: str | None = None) -> DataFrame:
    """Successful traces at development time; optionally without some repositories, of an agent, of models that contain a text."""
    out = traces.where(F.col("outcome.success") & (F.col("execution_context") == "devtime"))
    if excluded:
        out = out.where(~F.coalesce(F.col("task.repository").isin(excluded), F.lit(False)))
    if agent:
        out = out.where(F.col("agent.name") == agent)
    if model_part:
        out = out.where(F.contains(F.lower("agent.model"), F.lit(model_part.lower())))
    return out


def cross_rollup(rows: DataFrame, group: str, size: str, measure: str, distinct: str) -> DataFrame:
    """Size-weighted mean of a measure over groups and the distinct values of a column, nulls of the measure left out of its weight."""
    w = F.when(F.col(measure).isNotNull(), F.col(size))
    return rows.groupBy(group).agg(F.sum(size).alias("size"), F.bround(F.sum(F.col(measure) * F.col(size)) / F.nullif(F.sum(w), F.lit(0)), 4).alias("weighted_mean"), F.countDistinct(distinct).alias("n_distinct"))


def size_bucket(n: str) -> str:
    return f"CASE WHEN {n} < 100 THEN 'n<1K' WHEN {n} < 1000 THEN '1K<n<10K' WHEN {n} < 10000 THEN '10K<n<100K' ELSE 'n>100K' END"


def messages(traces: DataFrame) -> DataFrame:
    """Per batch a message of its first three tasks and the number of the others."""
    t = traces.where(F.coalesce(F.trim("task.description"), F.lit("")) != "").select("batch_no", "row_id", F.left("task.description", F.lit(40)).alias("x"))
    # three rows and a count per batch leave each task
    first = F.expr("slice(array_sort(collect_list(struct(row_id, x))), 1, 3)")
    from pyspark.sql import window as W

    w = W.Window.partitionBy("batch_no").orderBy("row_id")
    top = t.withColumn("r", F.row_number().over(w)).where(F.col("r") <= 3).groupBy("batch_no").agg(first.alias("f"))
    n = t.groupBy("batch_no").agg(F.count(F.lit(1)).alias("n"))
    text = F.array_join(F.transform("f", lambda v: v["x"]), "; ")
    return top.join(n, "batch_no").select("batch_no", F.when(F.col("n") > 3, F.concat(text, F.lit(" (+"), (F.col("n") - 3).cast("string"), F.lit(" more)"))).otherwise(text).alias("message"))


def judge_overall(rows: DataFrame, weights: DataFrame) -> DataFrame:
    """Per record and persona the weighted score (0 to 100) of ratings 1 to 5; a missing dimension counts 3, ratings are clamped.

    ``weights``(dimension, weight) is a table of a few rows.
    """
    keys = rows.select("record", "persona").distinct().join(F.broadcast(weights), F.lit(True))
    rated = rows.groupBy("record", "persona", "dimension").agg(F.max("score").alias("score"))
    j = keys.join(rated, ["record", "persona", "dimension"], "left")
    s = (F.least(F.greatest(F.coalesce("score", F.lit(3)), F.lit(1)), F.lit(5)) - 1) / 4 * 100
    return j.groupBy("record", "persona").agg(F.bround(F.sum(s * F.col("weight")) / F.sum("weight"), 1).alias("overall"))


def session_columns() -> dict[str, str]:
    return session_view(SPARK)
