"""Feature selection and data analytics on Spark DataFrames."""

from importlib import import_module

__version__ = "0.1.0"
#: Loaded when first asked for, so that Python workers which need one module don't load the others.
_PLACES = {"Selector": "sieveline.plans.selector", "Config": "sieveline.plans.config", "FeatureFrame": "sieveline.frame", "load_csv": "sieveline.sources.tables", "CATALOGUE": "sieveline.sources.tables"}
__all__ = [*_PLACES, "__version__"]


def __getattr__(name: str) -> object:
    if name in _PLACES:
        return getattr(import_module(_PLACES[name]), name)
    raise AttributeError(f"module 'sieveline' has no attribute {name!r}")
