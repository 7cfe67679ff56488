"""All queries of the library but the training-text ones, with their SQL."""

from __future__ import annotations

from . import ingest_jobs, jsonld_jobs, lint_jobs, page_jobs, publish_jobs, search_jobs, stream_jobs

_ALL = (search_jobs, lint_jobs, ingest_jobs, publish_jobs, page_jobs, jsonld_jobs, stream_jobs)
QUERIES = {name: f for module in _ALL for name, f in module.QUERIES.items()}
SQL = {name: text for module in _ALL for name, text in module.SQL.items()}
