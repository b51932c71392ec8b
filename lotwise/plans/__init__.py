"""Registered queries, one module per family."""

from importlib import import_module

MODULES = ["verdicts", "rules", "metrics", "thresholds", "scans", "curation", "vectors", "sampling", "robust", "lots", "heads", "streams"]


def load_all():
    from lotwise.plans.registry import REGISTRY

    for m in MODULES:
        import_module(f"lotwise.plans.{m}")
    return REGISTRY
