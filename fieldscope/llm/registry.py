"""All queries of this subpackage and their SQL."""

from __future__ import annotations

from importlib import import_module

_MODULES = ("urls", "decontaminate", "jaccard", "langid", "lines", "mixing", "quality", "shards", "tokens", "vectors", "topk", "resample", "periodic")
QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _name in _MODULES:
    _module = import_module(f"fieldscope.llm.{_name}")
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
