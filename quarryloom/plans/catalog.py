"""All named queries of the library and their oracles."""

from __future__ import annotations

from quarryloom.plans import base, fixtures, pages, policy, responses, structure  # noqa: F401  the modules register their queries

QUERIES, ORACLES = base.QUERIES, base.ORACLES
