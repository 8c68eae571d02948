"""Registered queries over the given tables, each with the SQL that checks it."""

import importlib
import pkgutil


def load() -> None:
    """Import every section, which registers its queries."""
    for module in sorted(m.name for m in pkgutil.iter_modules(__path__)):
        importlib.import_module(f"{__name__}.{module}")
