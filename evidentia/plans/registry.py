"""All registered queries of the engine and their SQL."""

from evidentia.plans import details, scale
from evidentia.plans.queries import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES", "details", "scale"]
