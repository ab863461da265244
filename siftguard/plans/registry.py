"""All registered queries."""

from siftguard.plans import documents, insiders, streams  # noqa: F401
from siftguard.plans.common import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
