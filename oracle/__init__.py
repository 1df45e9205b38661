"""DuckDB SQL with the same results as the Spark queries, for checking them."""

from oracle.statements import ORACLE_SQL

__all__ = ["ORACLE_SQL"]
