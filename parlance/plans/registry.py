"""All registered queries and their SQL."""

from __future__ import annotations

from . import dashboards, records, searches, speech, stages, texts, writes

_PARTS = (dashboards, records, searches, speech, stages, texts, writes)
QUERIES: dict = {name: f for part in _PARTS for name, f in part.QUERIES.items()}
SQL: dict[str, str] = {name: text for part in _PARTS for name, text in part.SQL.items()}
