"""All registered queries of the engine's own operators."""

from tagtally.plans import chains, enrichment, molecules, scans, selections, streams, summaries, tables  # noqa: F401
from tagtally.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
