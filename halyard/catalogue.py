"""All queries of the engine's own operators, with their SQL."""

from __future__ import annotations

from .plans import catalog, fingerprints, kernels, playback, scalars, sessions, statuses, upkeep

_MODULES = (fingerprints, catalog, scalars, sessions, statuses, upkeep, playback, kernels)
QUERIES = {name: q for m in _MODULES for name, q in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in _MODULES for name, sql in m.ORACLE_SQL.items()}
