"""Settings: defaults, a file, the environment, dotted paths; every change gives a new object."""

from __future__ import annotations

import copy
import json
import os
from collections.abc import Mapping
from typing import Any

DEFAULTS: dict[str, dict[str, Any]] = {
    "chunking": {"size": 500, "overlap": 50, "strategy": "auto"},
    "embedding": {"dimension": 384, "batch": 50},
    "retrieval": {"top_k": 10, "mode": "hybrid", "rrf_k": 60},
    "cache": {"max_entries": 10_000, "ttl_seconds": 3_600},
}
PREFIX = "QUARRY_"


class Config:
    def __init__(self, values: Mapping[str, Any] | None = None):
        self._values = merged(DEFAULTS, values or {})

    def get(self, path: str | None = None) -> Any:
        node: Any = self._values
        for part in path.split(".") if path else ():
            node = node.get(part) if isinstance(node, dict) else None
        return copy.deepcopy(node)

    def set(self, path: str, value: Any) -> Config:
        *heads, last = path.split(".")
        change: dict[str, Any] = {last: value}
        for h in reversed(heads):
            change = {h: change}
        return Config(merged(self._values, change))

    @classmethod
    def load(cls, path: str | None = None, environ: Mapping[str, str] | None = None) -> Config:
        """File over defaults, then QUARRY_SECTION_NAME over both; values are JSON where they can be."""
        values: dict[str, Any] = {}
        if path:
            with open(path) as f:
                values = json.load(f)
        out = cls(values)
        for key, text in (os.environ if environ is None else environ).items():
            if key.startswith(PREFIX):
                section, _, name = key[len(PREFIX) :].lower().partition("_")
                try:
                    value = json.loads(text)
                except ValueError:
                    value = text
                out = out.set(f"{section}.{name}", value)
        return out


def merged(base: Mapping[str, Any], over: Mapping[str, Any]) -> dict[str, Any]:
    out = copy.deepcopy(dict(base))
    for k, v in over.items():
        out[k] = merged(out[k], v) if isinstance(v, Mapping) and isinstance(out.get(k), dict) else copy.deepcopy(v)
    return out
