"""The registered queries: a name, a Spark plan over the test tables, and the same in SQL."""

from sluice.queries.registry import QUERIES, Tables, query

from sluice.queries import catalog, mapping, monitoring, plans, quality, relational  # noqa: F401, E402  (register)

__all__ = ["QUERIES", "Tables", "query"]
