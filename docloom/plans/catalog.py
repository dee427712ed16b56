"""All registered queries of the engine's own operators, with their SQL."""

from __future__ import annotations

from docloom.plans import hook_queries, index_queries, layout_queries, registry_queries, search_queries, state_queries, text_queries

MODULES = [text_queries, search_queries, registry_queries, layout_queries, hook_queries, index_queries, state_queries]
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLE = {name: sql for module in MODULES for name, sql in module.ORACLE.items()}
