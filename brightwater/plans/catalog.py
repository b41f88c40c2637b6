"""The registered queries and their SQL."""

from __future__ import annotations

from . import evaluation, search, store, text

MODULES = (search, store, evaluation, text)
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLES = {k: s for m in MODULES for k, s in m.ORACLES.items()}
