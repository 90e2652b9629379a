"""All queries of the engine's own operators, with their SQL."""

from __future__ import annotations

import importlib
import pkgutil

from . import plans
from .plans.base import ORACLES, QUERIES


def _load() -> None:
    for module in pkgutil.iter_modules(plans.__path__):
        importlib.import_module(f"{plans.__name__}.{module.name}")


def queries() -> dict:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict:
    _load()
    return dict(ORACLES)
