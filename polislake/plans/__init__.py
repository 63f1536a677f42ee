"""Named queries over the supplied tables."""

from __future__ import annotations

from importlib import import_module

_MODULES = ("scalars", "browse", "entities", "extraction", "reports", "questions", "streams", "incremental")


def load_all():
    """Import every query module and return the registry."""
    from polislake.plans.registry import QUERIES

    for module in _MODULES:
        import_module(f"polislake.plans.{module}")
    return QUERIES
