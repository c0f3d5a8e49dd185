"""Every query by name, in order."""

from __future__ import annotations

from tomeweave.plans import archives, entities, graph, layout, limits, qna, retrieval, rules, store, text

_MODULES = (text, store, retrieval, qna, graph, limits, entities, layout, archives, rules)

QUERIES = dict(sorted((n, q) for m in _MODULES for n, q in m.catalogue.queries.items()))
SQL = {n: s for m in _MODULES for n, s in m.catalogue.sql.items()}
