"""All queries of the library outside the text subpackage."""

from __future__ import annotations

from spanforge.plans import general, ingest, records, reports, signals, stats, views

FLAGSHIP = "quality_scores"
QUERIES = {**general.QUERIES, **records.QUERIES, **stats.QUERIES, **signals.QUERIES, **ingest.QUERIES, **views.QUERIES, **reports.QUERIES}
ORACLE = {**general.ORACLE, **records.ORACLE, **stats.ORACLE, **signals.ORACLE, **ingest.ORACLE, **views.ORACLE, **reports.ORACLE}
