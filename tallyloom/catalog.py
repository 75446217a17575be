"""All queries over the reference domain, by name, and their SQL for DuckDB."""

from .plans.queries import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
