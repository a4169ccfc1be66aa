"""Named queries over the test tables, each next to its SQL oracle."""

from importlib import import_module

_MODULES = ("filtering", "aggregating", "storing", "graphs", "topical", "spatial", "streams")


def load_all():
    """(queries, oracles) of every catalog module."""
    from agoraflow import registry

    for name in _MODULES:
        import_module(f"agoraflow.catalog.{name}")
    return dict(registry.QUERIES), dict(registry.ORACLES)
