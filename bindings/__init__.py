"""Queries bound to the test tables, each beside the SQL that checks it."""

from importlib import import_module

MODULES = ("scores", "payments", "funding", "subscribers", "demand", "catalogue", "search", "files", "learning")


def load_all() -> None:
    for name in MODULES:
        import_module(f"bindings.{name}")
