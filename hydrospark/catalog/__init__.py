"""Queries over the driver's tables, one module per section of the inventory."""

import importlib
import pkgutil

from hydrospark.catalog.base import ORACLES, QUERIES

for _m in sorted(m.name for m in pkgutil.iter_modules(__path__)):
    if _m.startswith("q_"):
        importlib.import_module(f"{__name__}.{_m}")

__all__ = ["ORACLES", "QUERIES"]
