"""Every registered query and the SQL that must give the same rows."""

from __future__ import annotations

from gneiss.plans import cameras, evaluation, graph, ledger, proposals, records, relational, scalars, selection, solving

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _part in (cameras, evaluation, graph, ledger, proposals, records, relational, scalars, selection, solving):
    QUERIES.update(_part.QUERIES)
    ORACLES.update(_part.ORACLES)
