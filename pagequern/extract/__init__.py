"""Extraction of one page, in plain Python: head, cleaning, site handlers, Markdown and text."""
