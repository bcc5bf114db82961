"""Every registered query with its check text."""

import importlib
import pkgutil

from scanfleet.catalog.registry import ENTRIES

for _m in sorted(m.name for m in pkgutil.iter_modules(__path__)):
    if _m != "registry":
        importlib.import_module(f"{__name__}.{_m}")

__all__ = ["ENTRIES"]
