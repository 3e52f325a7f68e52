"""Registered queries: the library's operators bound to the given tables."""

from importlib import import_module

MODULES = ["trips", "records", "questions", "evaluation", "learning", "streams", "jobs"]


def load():
    """All registered queries and oracles."""
    from velobus.bindings import registry

    for name in MODULES:
        import_module(f"velobus.bindings.{name}")
    return dict(registry.QUERIES), dict(registry.ORACLES)
