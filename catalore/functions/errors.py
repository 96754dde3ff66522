"""The one error of queries that can't be understood."""


class QueryError(ValueError):
    """A query that is not well formed."""
