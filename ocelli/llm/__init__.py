"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it.  Its functions travel to executors
by value, so executors need numpy and pyarrow but not this package.
"""

from __future__ import annotations

import importlib
import pkgutil

from pyspark import cloudpickle

for _module in pkgutil.iter_modules(__path__):
    if _module.name != "queries":
        cloudpickle.register_pickle_by_value(importlib.import_module(f"{__name__}.{_module.name}"))
