"""Spark-native extraction of structured columns from raw web pages.

The public names are loaded when they are first used, so that Python workers,
which need only the modules of their own stage, start fast.
"""

from importlib import import_module

__version__ = "0.1.0"

_PUBLIC = {"AsyncWebExtractor": "quarryweb.api", "ExtractionResult": "quarryweb.api", "WebExtractor": "quarryweb.api", "batch_extract": "quarryweb.api", "Request": "quarryweb.plans", "extract": "quarryweb.plans"}
__all__ = ["AsyncWebExtractor", "ExtractionResult", "Request", "WebExtractor", "batch_extract", "extract"]


def __getattr__(name: str):
    if name in _PUBLIC:
        return getattr(import_module(_PUBLIC[name]), name)
    raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
