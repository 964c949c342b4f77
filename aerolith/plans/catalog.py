"""All queries of the library by name: (callable, SQL or None)."""

from __future__ import annotations

from . import anomaly_queries, control_queries, event_queries, evidence_queries, field_queries, forensic_queries, state_queries, stream_queries

CATALOG = {**anomaly_queries.QUERIES, **control_queries.QUERIES, **event_queries.QUERIES, **evidence_queries.QUERIES, **field_queries.QUERIES, **forensic_queries.QUERIES, **state_queries.QUERIES, **stream_queries.QUERIES}
