"""A relational and vector engine on Spark: a SQL dialect over Catalyst, versioned tables, time travel, a log follower."""

from quillon.engine import Engine, EngineError, QueryResult, Session
from quillon.plans.statement import Statement, parse

__all__ = ["Engine", "EngineError", "QueryResult", "Session", "Statement", "parse"]
