"""All registered queries of the graph engine and their DuckDB SQL."""

from symgraph.plans import extraction  # noqa: F401 - adds its queries
from symgraph.plans.catalogue import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
