"""Connected components, as the survey operators find them."""

from ..operators.graph import components

__all__ = ["components"]
