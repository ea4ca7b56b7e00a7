"""All registered queries of the document engine, with the SQL that gives the same rows."""

from __future__ import annotations

from . import queries_lines, queries_sections, queries_services, queries_session, queries_text

FLAGSHIP = "clean_page_numbers_by_lang"
_MODULES = (queries_lines, queries_text, queries_sections, queries_session, queries_services)


def queries() -> dict:
    return {k: f for m in _MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in _MODULES for k, s in m.SQL.items()}
