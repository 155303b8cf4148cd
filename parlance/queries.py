"""The queries on the driver's tables, by name, and their DuckDB SQL."""

from __future__ import annotations

from .plans import evaluation, learning, measures, profiles, records, scoring, segments, speech, streams, texts, voices

_MODULES = (speech, voices, texts, scoring, records, segments, evaluation, profiles, streams, learning, measures)
QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLE_SQL = {name: sql for module in _MODULES for name, sql in module.ORACLE_SQL.items()}
FLAGSHIP = "m0_speaker_entries"
