"""Queries of the general training-data problems (1, 2 and 4)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.operators import drift, flatten, profile
from spanforge.sources.tables import LINK_SCHEMA, table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return profile.issues(table(spark, d, "step_usage"), table(spark, d, "field_specs"), table(spark, d, "field_checks"))


def p1_profile(spark: SparkSession, d: str) -> DataFrame:
    return profile.load_profile(table(spark, d, "step_usage"), table(spark, d, "field_specs"))


def p1_distinct(spark: SparkSession, d: str) -> DataFrame:
    return profile.load_distincts(table(spark, d, "step_usage"), table(spark, d, "field_specs"))


def p1_masks(spark: SparkSession, d: str) -> DataFrame:
    return profile.mask_report(table(spark, d, "step_usage"), table(spark, d, "field_specs"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return flatten.child_links(table(spark, d, "traces", LINK_SCHEMA))


def p2_steps(spark: SparkSession, d: str) -> DataFrame:
    return flatten.steps_table(
        table(spark, d, "traces", "row_id bigint, steps array<struct<step_index:bigint, role:string, content:string, model:string, parent_step:bigint, call_type:string, timestamp:string>>")
    )


def p2_calls(spark: SparkSession, d: str) -> DataFrame:
    return flatten.calls_table(table(spark, d, "traces", "row_id bigint, steps array<struct<tool_calls:array<struct<tool_call_id:string, tool_name:string, input:string, duration_ms:bigint>>>>"))


def p2_observations(spark: SparkSession, d: str) -> DataFrame:
    return flatten.observations_table(
        table(
            spark, d, "traces",
            "row_id bigint, steps array<struct<tool_calls:array<struct<tool_call_id:string>>, observations:array<struct<source_call_id:string, content:string, output_summary:string, error:string>>>>",
        )
    )


def p2_ranges(spark: SparkSession, d: str) -> DataFrame:
    return flatten.ranges_table(
        table(
            spark, d, "traces",
            "row_id bigint, steps array<struct<step_index:bigint>>, attribution struct<files:array<struct<path:string, conversations:array<struct<url:string, "
            "ranges:array<struct<start_line:bigint, end_line:bigint, content_hash:string, confidence:string>>>>>>>",
        )
    )


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return drift.migration_steps(table(spark, d, "raw_records")).select("file_name", "old_path", "new_path", "change_kind")


def p4_table(spark: SparkSession, d: str) -> DataFrame:
    return drift.unify(table(spark, d, "raw_records"))


def p4_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    return drift.fingerprints(table(spark, d, "raw_records")).select("producer", "file_no", "file_name", "path", F.coalesce("kind", F.lit("null")).alias("kind"))


def p4_rules(spark: SparkSession, d: str) -> DataFrame:
    return drift.rules(table(spark, d, "raw_records"))


QUERIES: dict[str, Query] = {
    f.__name__: f for f in (p1_found, p1_profile, p1_masks, p1_distinct, p2_found, p2_steps, p2_calls, p2_observations, p2_ranges, p4_found, p4_table, p4_fingerprints, p4_rules)
}

_STEPS = "SELECT row_id, i - 1 AS sp, steps[i] AS s, steps FROM (SELECT row_id, steps, unnest(range(1, len(steps) + 1)) AS i FROM traces)"
_CALLS = f"SELECT row_id, sp, s, j - 1 AS cp, s.tool_calls[j] AS c FROM (SELECT *, unnest(range(1, len(s.tool_calls) + 1)) AS j FROM ({_STEPS}))"
_OBS = f"SELECT row_id, sp, s, j - 1 AS op, s.observations[j] AS o FROM (SELECT *, unnest(range(1, len(s.observations) + 1)) AS j FROM ({_STEPS}))"
_FILES = "SELECT row_id, steps, i - 1 AS fp, attribution.files[i] AS f FROM (SELECT row_id, steps, attribution, unnest(range(1, len(attribution.files) + 1)) AS i FROM traces)"
_CONVS = f"SELECT row_id, steps, fp, f.path AS file_path, j - 1 AS vp, f.conversations[j] AS v FROM (SELECT *, unnest(range(1, len(f.conversations) + 1)) AS j FROM ({_FILES}))"
_RANGES = f"SELECT row_id, steps, fp, vp, file_path, v, k - 1 AS rp, v.ranges[k] AS r FROM (SELECT *, unnest(range(1, len(v.ranges) + 1)) AS k FROM ({_CONVS}))"
_OBS_PARENT = "COALESCE(sp::VARCHAR || '.' || (list_position(list_transform(s.tool_calls, lambda x: x.tool_call_id), NULLIF(o.source_call_id, '')) - 1)::VARCHAR, '')"
_RANGE_PARENT = "COALESCE((list_position(list_transform(steps, lambda x: x.step_index), TRY_CAST(NULLIF(regexp_extract(v.url, '([0-9]+)\\s*$', 1), '') AS BIGINT)) - 1)::VARCHAR, '')"
# list_position gives null where there is no such element
_P2 = f"""
SELECT row_id, 'call' AS child_kind, sp || '.' || cp AS child_path, sp::VARCHAR AS parent_path FROM ({_CALLS})
UNION ALL SELECT row_id, 'observation', sp || '.' || op, {_OBS_PARENT} FROM ({_OBS})
UNION ALL SELECT row_id, 'range', fp || '.' || vp || '.' || rp, {_RANGE_PARENT} FROM ({_RANGES})
"""

_P1_COLS = [("role", 0), ("call_type", 0), ("model", 0), ("tool_name", 0), ("system_prompt_hash", 0), ("step_ts", 0), ("input_tokens", 1), ("output_tokens", 1), ("cache_read_tokens", 1), ("duration_ms", 1)]
_STAND = ", ".join(f"'{x}'" for x in profile.STAND_INS)
_LONG = " UNION ALL ".join(
    f"SELECT load_id, COALESCE(feed, '') AS feed, '{c}' AS column_name, {c}::VARCHAR AS v, "
    + (f"COALESCE({c} = -1, TRUE) AS gone, CASE WHEN {c} <> -1 THEN {c}::DOUBLE END AS num" if n else f"COALESCE(lower(trim({c})) IN ({_STAND}), TRUE) AS gone, NULL::DOUBLE AS num")
    + " FROM step_usage"
    for c, n in _P1_COLS
)
_P1 = f"""
WITH cells AS (SELECT l.*, s.value_pattern FROM ({_LONG}) l JOIN field_specs s USING (column_name)),
 per AS (SELECT feed, load_id, column_name, count(*) AS n, count(*) FILTER (NOT gone) AS present,
   count(*) FILTER (NOT gone AND value_pattern IS NOT NULL AND NOT regexp_full_match(v, value_pattern)) AS bad, quantile_disc(num, 0.5) AS med
   FROM cells GROUP BY ALL),
 firsts AS (SELECT feed, column_name, min(load_id) AS load_id FROM per GROUP BY ALL),
 f AS (SELECT per.* FROM per JOIN firsts USING (feed, column_name, load_id)),
 vn AS (SELECT feed, load_id, column_name, v, count(*) AS n FROM cells WHERE NOT gone AND column_name IN ('role', 'call_type', 'model', 'tool_name') GROUP BY ALL),
 sh AS (SELECT feed, load_id, column_name, v, n / sum(n) OVER (PARTITION BY feed, load_id, column_name) AS share FROM vn),
 fsh AS (SELECT sh.* FROM sh JOIN firsts USING (feed, column_name, load_id)),
 pairs AS (SELECT p.feed, p.load_id, p.column_name, x.v, x.share AS a, 0.0 AS b FROM per p JOIN sh x USING (feed, load_id, column_name)
   UNION ALL SELECT p.feed, p.load_id, p.column_name, y.v, 0.0, y.share FROM per p JOIN fsh y USING (feed, column_name)),
 mix AS (SELECT feed, load_id, column_name, sum(abs(d)) / 2 AS dist FROM (SELECT feed, load_id, column_name, v, sum(a) - sum(b) AS d FROM pairs GROUP BY ALL) GROUP BY ALL),
 rep AS (SELECT c.load_id, s.column_name, c.population_rate FROM field_checks c JOIN field_specs s USING (path) WHERE s.column_name IS NOT NULL
   QUALIFY row_number() OVER (PARTITION BY c.load_id, s.column_name ORDER BY c.reported_at DESC NULLS LAST, c.check_id DESC) = 1)
SELECT DISTINCT load_id, column_name, issue FROM (
 SELECT p.load_id, p.column_name, 'missing' AS issue FROM per p JOIN f USING (feed, column_name) WHERE p.load_id <> f.load_id AND abs((p.n - p.present) / p.n - (f.n - f.present) / f.n) >= 0.15 - 1e-9
 UNION ALL SELECT load_id, column_name, 'pattern' FROM per WHERE present > 0 AND bad / present >= 0.05 - 1e-9
 UNION ALL SELECT p.load_id, p.column_name, 'range' FROM per p JOIN f USING (feed, column_name) WHERE p.load_id <> f.load_id AND f.med > 0 AND (p.med >= 3 * f.med OR p.med <= f.med / 3)
 UNION ALL SELECT m.load_id, m.column_name, 'mix' FROM mix m JOIN per p USING (feed, load_id, column_name) JOIN f USING (feed, column_name) WHERE m.load_id <> f.load_id AND p.present > 0 AND f.present > 0 AND dist >= 0.2 - 1e-9
 UNION ALL SELECT p.load_id, p.column_name, 'report' FROM per p JOIN rep r USING (load_id, column_name) WHERE abs(r.population_rate - p.present / p.n) > 0.02 + 1e-9)
"""

# masks in SQL: digits, letters but T and Z, and the two special forms; numbers by sign and digits
_LETTERS = "ABCDEFGHIJKLMNOPQRSUVWXY"
_MASK = f"""CASE WHEN gone THEN NULL WHEN num IS NOT NULL THEN CASE WHEN num < 0 THEN '-9x' ELSE '9x' END || length(abs(num)::VARCHAR)
 WHEN regexp_full_match(v, '[0-9a-f]{{8,}}') THEN 'h' || length(v) WHEN regexp_full_match(v, '[0-9A-F]{{8,}}') THEN 'H' || length(v)
 ELSE translate(v, 'abcdefghijklmnopqrstuvwxyz{_LETTERS}0123456789', repeat('a', 26) || repeat('A', 24) || repeat('9', 10)) END"""
_CELLS = " UNION ALL ".join(
    f"SELECT load_id, COALESCE(feed, '') AS feed, '{c}' AS column_name, {c}::VARCHAR AS v, "
    + (f"COALESCE({c} = -1, TRUE) AS gone, CASE WHEN {c} <> -1 THEN {c} END AS num" if n else f"COALESCE(lower(trim({c})) IN ({_STAND}), TRUE) AS gone, NULL::BIGINT AS num")
    + " FROM step_usage"
    for c, n in _P1_COLS
)
_MASKED = f"""WITH cells AS (SELECT l.*, {_MASK} AS mask, NOT gone AND value_pattern IS NOT NULL AND NOT regexp_full_match(v, value_pattern) AS bad FROM ({_CELLS}) l JOIN field_specs s USING (column_name)),
 m0 AS (SELECT feed, load_id, column_name, mask, count(*) AS n, count(*) FILTER (bad) AS n_bad FROM cells WHERE mask IS NOT NULL GROUP BY ALL),
 m1 AS (SELECT *, n / sum(n) OVER (PARTITION BY feed, load_id, column_name) AS share, min(load_id) OVER (PARTITION BY feed, column_name) AS first_load FROM m0),
 m2 AS (SELECT *, coalesce(max(CASE WHEN load_id = first_load THEN share END) OVER (PARTITION BY feed, column_name, mask), 0.0) AS first_share FROM m1),
 masks AS (SELECT feed, load_id, column_name, mask, n, n_bad, share, first_share, first_share < 0.05 - 1e-9 AS is_rare FROM m2)"""
_P1_PROFILE = f"""{_MASKED},
 per AS (SELECT feed, load_id, column_name, count(*) AS n_rows, count(*) FILTER (gone) AS n_missing, count(*) FILTER (bad) AS n_bad,
   coalesce(min(num)::VARCHAR, min(v) FILTER (NOT gone)) AS min_value, coalesce(max(num)::VARCHAR, max(v) FILTER (NOT gone)) AS max_value, quantile_disc(num, 0.5)::DOUBLE AS median_value FROM cells GROUP BY ALL),
 first_of AS (SELECT feed, column_name, min(load_id) AS first_load FROM per GROUP BY ALL),
 top AS (SELECT feed, load_id, column_name, max_by(mask, (n, mask)) AS top_mask, coalesce(sum(n) FILTER (is_rare), 0) / sum(n) AS rare_mask_share FROM masks GROUP BY ALL),
 pairs AS (SELECT p.feed, p.load_id, p.column_name, x.mask, x.share AS d FROM per p JOIN masks x USING (feed, load_id, column_name)
   UNION ALL SELECT p.feed, p.load_id, p.column_name, y.mask, -y.share FROM per p JOIN first_of f USING (feed, column_name) JOIN masks y ON y.feed = p.feed AND y.column_name = p.column_name AND y.load_id = f.first_load),
 div AS (SELECT feed, load_id, column_name, sum(abs(d)) / 2 AS mask_divergence FROM (SELECT feed, load_id, column_name, mask, sum(d) AS d FROM pairs GROUP BY ALL) GROUP BY ALL)
SELECT p.feed, p.load_id, p.column_name, n_rows, n_missing, n_bad, min_value, max_value, median_value, top_mask, rare_mask_share, n_missing / n_rows AS missing_share,
 CASE WHEN p.load_id <> f.first_load AND t.top_mask IS NOT NULL AND EXISTS (SELECT 1 FROM masks y WHERE y.feed = p.feed AND y.column_name = p.column_name AND y.load_id = f.first_load) THEN mask_divergence END AS mask_divergence
FROM per p JOIN first_of f USING (feed, column_name) LEFT JOIN top t USING (feed, load_id, column_name) LEFT JOIN div d USING (feed, load_id, column_name)"""

# fields of each file in SQL: the leaves of an object are the paths that lead to no object (an empty object is none)
_P4_FINGERPRINTS = """
WITH RECURSIVE lines AS (SELECT DISTINCT producer, file_seq, file_name, body FROM raw_records WHERE json_valid(body) AND json_type(CASE WHEN json_valid(body) THEN body END) = 'OBJECT'),
 recs AS (SELECT *, row_number() OVER () AS r FROM lines),
 tree AS (SELECT r, k AS path, body::JSON -> ('$."' || replace(k, '"', '\\"') || '"') AS v FROM (SELECT r, body, unnest(json_keys(body)) AS k FROM recs)
   UNION ALL SELECT r, path || '.' || k, v -> ('$."' || replace(k, '"', '\\"') || '"') FROM (SELECT r, path, v, unnest(json_keys(v)) AS k FROM tree WHERE json_type(v) = 'OBJECT')),
 kinds AS (SELECT r, path, CASE json_type(v) WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'ARRAY' THEN 'array' WHEN 'NULL' THEN 'null' ELSE 'number' END AS kind FROM tree WHERE json_type(v) <> 'OBJECT'),
 files AS (SELECT *, row_number() OVER (PARTITION BY producer ORDER BY file_seq NULLS LAST, file_name) AS file_no FROM (SELECT producer, file_seq, file_name, count(*) AS n_records FROM recs GROUP BY ALL)),
 n AS (SELECT producer, file_no, file_name, n_records, path, kind, count(*) AS n FROM kinds JOIN recs USING (r) JOIN files USING (producer, file_seq, file_name) GROUP BY ALL),
 had AS (SELECT producer, file_no, file_name, path, max(n) FILTER (kind <> 'null') AS most, list({'k': kind, 'n': n}) AS ks FROM n GROUP BY producer, file_no, file_name, n_records, path HAVING sum(n) >= 0.1 * n_records),
 top AS (SELECT *, list_sort(list_transform(list_filter(ks, lambda x: x.k <> 'null' AND x.n = most), lambda x: x.k)) AS t FROM had),
 old AS (SELECT *, last_value(t[1] IGNORE NULLS) OVER (PARTITION BY producer, path ORDER BY file_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM top)
SELECT producer, file_no, file_name, path, CASE WHEN list_contains(t, before) THEN before ELSE coalesce(t[1], before, 'null') END AS kind FROM old
"""

ORACLE: dict[str, str] = {
    "p4_fingerprints": _P4_FINGERPRINTS,
    "p1_found": _P1,
    "p1_masks": f"{_MASKED} SELECT * FROM masks",
    "p1_profile": _P1_PROFILE,
    "p2_found": _P2,
    "p2_calls": f"SELECT row_id, sp::INT AS step_pos, cp::INT AS call_pos, sp || '.' || cp AS call_path, sp::VARCHAR AS parent_path, c.tool_call_id, c.tool_name, c.input, c.duration_ms FROM ({_CALLS})",
    "p2_observations": f"SELECT row_id, sp::INT AS step_pos, op::INT AS obs_pos, sp || '.' || op AS obs_path, {_OBS_PARENT} AS parent_path, o.source_call_id, o.content, o.output_summary, o.error FROM ({_OBS})",
    "p2_ranges": f"SELECT row_id, fp::INT AS file_pos, vp::INT AS conv_pos, rp::INT AS range_pos, fp || '.' || vp || '.' || rp AS range_path, {_RANGE_PARENT} AS parent_path, file_path, v.url, r.start_line, r.end_line, r.content_hash, r.confidence FROM ({_RANGES})",
    "p2_steps": f"SELECT row_id, sp::INT AS step_pos, sp::VARCHAR AS step_path, s.step_index, s.role, s.call_type, s.model, s.parent_step, COALESCE((list_position(list_transform(steps, lambda x: x.step_index), s.parent_step) - 1)::VARCHAR, '') AS parent_path, s.content, s.timestamp FROM ({_STEPS})",
}
