"""Registered queries: each runs one operator over the driver's tables."""

from importlib import import_module

MODULES = ["basics", "statistics", "series", "neighbours", "learning"]


def load_all() -> None:
    for name in MODULES:
        import_module(f"{__name__}.{name}")
