"""The registered queries of the engine proper, with their SQL."""

from tarn.plans import q_catalog, q_checks, q_formats, q_forms, q_logs, q_rules, q_search, q_sources, q_tables, q_text

MODULES = [q_search, q_tables, q_logs, q_text, q_catalog, q_sources, q_checks, q_rules, q_forms, q_formats]
QUERIES: dict = {}
ORACLE_SQL: dict = {}
for _module in MODULES:
    QUERIES |= _module.QUERIES
    ORACLE_SQL |= _module.ORACLE_SQL
