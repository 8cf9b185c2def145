"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from inkfold.llm import cutoffs, defects, families, lookalike, nearcopy, overlap, packing, terms, tokens

_MODULES = (defects, cutoffs, terms, nearcopy, families, overlap, tokens, packing, lookalike)
QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
