"""Functions of the query language. Importing this package registers them all."""

from siltstone.functions import content, filters, geo, grouping, normalize, query  # noqa: F401
