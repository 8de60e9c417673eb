"""Registered queries of the library and their SQL, by name."""

from __future__ import annotations

from . import content, contents, conversation, history, judging, metrics, records, searching, spaces, specs, variation

MODULES = (conversation, metrics, history, content, searching, records, contents, variation, spaces, judging, specs)
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
SQL = {name: sql for module in MODULES for name, sql in module.SQL.items()}
FLAGSHIP = "conversation_efficiency"
