"""Query plans over the given tables."""

from __future__ import annotations

from importlib import import_module

MODULES = ("timeline", "tracks", "editing", "boxes", "labels", "signals", "dataset", "reviews", "layers", "files")


def all_queries() -> tuple[dict, dict]:
    from fieldscope.plans import registry

    for name in MODULES:
        import_module(f"fieldscope.plans.{name}")
    return dict(registry.QUERIES), dict(registry.ORACLES)
