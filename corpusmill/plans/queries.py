"""All queries of the core."""

from __future__ import annotations

from corpusmill.plans import batches, corpora, gradings, nested, numerics, queues, rollups, selections  # noqa: F401 - they register their queries
from corpusmill.plans.registry import REGISTRY

QUERIES = REGISTRY.queries
ORACLES = REGISTRY.oracles
