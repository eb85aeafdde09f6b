"""Operators for preparing training corpora from documents and web pages."""
