"""Readers and writers: tables by name, HTML file trees, request bodies, result sinks."""

from pagequern.sources.tables import read_table

__all__ = ["read_table"]
