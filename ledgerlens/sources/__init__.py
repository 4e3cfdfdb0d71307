"""Readers and writers: chain tables, registry, results, fixture adapter."""

from ledgerlens.sources.tables import ChainTables

__all__ = ["ChainTables"]
