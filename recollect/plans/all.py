"""All queries but those of the optional subpackage."""

from recollect.plans import datasets, documents, entities, graph, listing, logs, recall, sources, streams, tiers, vectors  # noqa: F401
from recollect.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
