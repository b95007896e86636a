"""Registered queries over the given tables, one module per operator family."""

from importlib import import_module

MODULES = ["metrics", "derived", "text", "search", "filings", "qlogs", "streams"]


def load():
    """Import every catalog module and return the registry."""
    for m in MODULES:
        import_module(f"quillstat.catalog.{m}")
    from quillstat.catalog.base import REGISTRY

    return REGISTRY
