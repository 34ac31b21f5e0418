"""All registered queries."""

import importlib
import pkgutil


def load_catalog():
    from gapmend.catalog import base
    for m in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{m.name}")
    return base.QUERIES, base.ORACLE
