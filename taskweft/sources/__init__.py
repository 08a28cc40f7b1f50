"""Readers."""

from taskweft.sources.tables import table

__all__ = ["table"]
