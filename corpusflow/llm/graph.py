"""Connected components of a link table: those of the library's operators."""

from ..operators.graph import components

__all__ = ["components"]
