"""Named queries over the test tables."""

import importlib

_MODULES = ["movement", "exploration", "evaluation", "threat", "shots", "tables", "models", "mixtures", "suffixes", "publishing", "uncertainty", "storage"]


def load():
    """Import every query module and return the registry."""
    for name in _MODULES:
        importlib.import_module(f"{__name__}.{name}")
    return importlib.import_module(f"{__name__}.registry")
