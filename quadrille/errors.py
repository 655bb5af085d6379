"""Errors of the query language and the grids."""


class QuerySyntaxError(ValueError):
    """A query text that the grammar does not have."""


class UnsupportedFeature(ValueError):
    """A query node that is recognised but that this backend does not evaluate."""


class InvalidPixel(ValueError):
    """A pixel id, child number or level that the grid does not have."""
