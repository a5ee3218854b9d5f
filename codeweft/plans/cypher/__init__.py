"""Read-only Cypher over a code graph: parsed here, planned as DataFrame operations."""

from codeweft.plans.cypher.parser import QueryError, parse
from codeweft.plans.cypher.planner import run

__all__ = ["QueryError", "parse", "run"]
