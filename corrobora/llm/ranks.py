"""Places of rows inside their groups, and joins with hot keys; see :mod:`corrobora.operators.ranks`."""

from corrobora.operators.ranks import hot_join, numbered, ordered

__all__ = ["hot_join", "numbered", "ordered"]
