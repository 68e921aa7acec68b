"""Queries of the text problems (3, 5, 6, 7, 8 and 9)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from spanforge.llm import history, leakage, mixing, personal, quality, secrets
from spanforge.sources.tables import CONTENT_SCHEMA, TEXT_SCHEMA, table

Query = Callable[[SparkSession, str], DataFrame]


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return secrets.found(table(spark, d, "traces", TEXT_SCHEMA))


def p3_redacted(spark: SparkSession, d: str) -> DataFrame:
    return secrets.redacted(table(spark, d, "traces", TEXT_SCHEMA))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return history.repeats(table(spark, d, "traces", CONTENT_SCHEMA))


def p5_batches(spark: SparkSession, d: str) -> DataFrame:
    return history.batch_split(table(spark, d, "traces", CONTENT_SCHEMA))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return personal.found(table(spark, d, "traces", TEXT_SCHEMA))


def p6_redacted(spark: SparkSession, d: str) -> DataFrame:
    return personal.redacted(table(spark, d, "traces", TEXT_SCHEMA))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p7_items(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leak_report(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_mixture(spark: SparkSession, d: str) -> DataFrame:
    sized = mixing.sized_documents(table(spark, d, "documents"))
    return mixing.mixture(sized, mixing.plan(sized, table(spark, d, "mix_targets")))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    sized = mixing.sized_documents(table(spark, d, "documents"))
    planned = mixing.plan(sized, table(spark, d, "mix_targets"))
    return mixing.shares(mixing.mixture(sized, planned), planned)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return quality.found(table(spark, d, "documents"), table(spark, d, "doc_labels"))


def p9_statistics(spark: SparkSession, d: str) -> DataFrame:
    return quality.document_statistics(table(spark, d, "documents"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (p3_found, p3_redacted, p5_found, p5_batches, p6_found, p6_redacted, p7_found, p7_items, p8_mixture, p8_shares, p9_found, p9_statistics)}
_COMMON = ", ".join(f"'{w}'" for w in sorted(w for w in quality.COMMON if w.isascii()))
_P9 = f"""
WITH t AS (SELECT doc_id, COALESCE(text, '') AS x FROM documents),
 w AS (SELECT doc_id, x,
   list_filter(string_split(regexp_replace(x, '[ \t\r\n]+', ' ', 'g'), ' '), lambda a: a <> '') AS tok,
   list_filter(string_split(regexp_replace(x, '\r\n|\r', chr(10), 'g'), chr(10)), lambda a: regexp_replace(a, '[ \t]+', '', 'g') <> '') AS lin,
   list_filter(string_split(regexp_replace(lower(x), '[^a-z]+', ' ', 'g'), ' '), lambda a: a <> '') AS wrd FROM t)
SELECT doc_id, len(tok)::BIGINT AS n_words, CASE WHEN len(tok) > 0 THEN list_sum(list_transform(tok, lambda a: length(a))) / len(tok) END AS mean_word_length,
 CASE WHEN length(x) > 0 THEN length(regexp_replace(x, '[A-Za-z0-9 \t\r\n]+', '', 'g')) / length(x) END AS symbol_ratio,
 CASE WHEN len(lin) > 0 THEN len(list_filter(lin, lambda a: regexp_matches(a, '[.!?:;][ \t]*$'))) / len(lin) END AS punctuated_line_share,
 CASE WHEN len(wrd) > 0 THEN len(list_filter(wrd, lambda a: a IN ({_COMMON}))) / len(wrd) END AS common_word_share FROM w
"""

ORACLE: dict[str, str] = {"p9_statistics": _P9}
