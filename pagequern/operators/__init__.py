"""DataFrame operators over pages."""

from pagequern.operators.pages import extract, extract_requests, messages, nodes, register_functions

__all__ = ["extract", "extract_requests", "messages", "nodes", "register_functions"]
