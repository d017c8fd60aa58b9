"""Every operator as a query over the given tables."""

import importlib

MODULES = ("assessment", "terrain", "series", "registry")


def load():
    """Name to query, in registration order."""
    for m in MODULES:
        importlib.import_module(f"floodspark.queries.{m}")
    from floodspark.queries.base import REGISTRY
    return REGISTRY
