"""All registered queries of the library, gathered from the modules of this package."""

from __future__ import annotations

from importlib import import_module

MODULES = ("scalars", "lines", "library", "tenders", "files", "offers")


def _gathered(what: str) -> dict:
    out = {}
    for name in MODULES:
        out |= getattr(import_module(f"{__package__}.{name}"), what)
    return out


def queries() -> dict:
    return _gathered("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _gathered("SQL")
