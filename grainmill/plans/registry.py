"""Every registered query of the package, with its SQL where SQL can express it."""

from __future__ import annotations

from . import corpora, curation, evaluation, extras, pairs, records, streamed, suite_cases, suites, texts

_MODULES = (curation, texts, evaluation, suites, corpora, records, extras, pairs, streamed, suite_cases)
QUERIES: dict = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {name: q for m in _MODULES for name, q in m.ORACLE_SQL.items()}
