"""HTML parsing into a light tree, without third-party parsers."""

from quarryweb.html.tree import Element, parse

__all__ = ["Element", "parse"]
