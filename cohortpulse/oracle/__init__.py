"""The same queries as DuckDB SQL, written independently of the Spark plans."""

from cohortpulse.oracle.queries import oracle_queries

__all__ = ["oracle_queries"]
