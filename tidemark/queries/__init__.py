"""Named queries over the supplied tables, one per operator."""

from __future__ import annotations

import importlib
from types import ModuleType

MODULES = ("core", "events", "derived", "evaluate", "relations", "feeds", "matrix")


def load_all() -> ModuleType:
    """Import every query module and return the registry."""
    for name in MODULES:
        importlib.import_module(f"{__name__}.{name}")
    return importlib.import_module(f"{__name__}.registry")
