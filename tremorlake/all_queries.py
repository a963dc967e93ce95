"""Every query of the engine's own operators, by name, and their SQL."""

from __future__ import annotations

from tremorlake import queries, queries_audit, queries_models, queries_process, queries_rates

QUERIES, SQL = queries.QUERIES, queries.SQL
MODULES = [queries, queries_audit, queries_rates, queries_process, queries_models]
