"""Registered queries over the given tables."""

from importlib import import_module
from pkgutil import iter_modules


def load_all() -> None:
    """Imports every ``q_*`` module; each registers its queries."""
    for m in sorted(x.name for x in iter_modules(__path__)):
        if m.startswith("q_"):
            import_module(f"{__name__}.{m}")
