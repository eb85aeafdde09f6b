"""Options of an extraction."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Options:
    debug: bool = False
    #: Markdown in place of HTML content; Markdown beside it.
    markdown: bool = False
    separate_markdown: bool = False
    remove_exact_selectors: bool = True
    remove_partial_selectors: bool = True
    #: More substrings of class, id and test attributes that mark clutter.
    extra_partial: tuple[str, ...] = ()
