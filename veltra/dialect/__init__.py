"""Text of the SQL dialect to syntax trees."""

from veltra.dialect.parser import parse

__all__ = ["parse"]
