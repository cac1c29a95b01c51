"""Plug-ins by type and name: embedders, chunkers, rerankers and stores that a user adds."""

from __future__ import annotations

import importlib
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

TYPES = ("embedder", "chunker", "retriever", "reranker", "index-store", "cache-store", "evaluator")


@dataclass
class Plugin:
    name: str
    type: str
    version: str
    make: Callable[..., Any]
    needs: tuple[str, ...] = ()
    status: str = "registered"
    errors: list[str] = field(default_factory=list)


class Registry:
    def __init__(self) -> None:
        self._plugins: dict[str, Plugin] = {}

    def register(self, plugin: Plugin) -> None:
        if plugin.type not in TYPES:
            raise ValueError(f"unknown type {plugin.type}")
        if not plugin.name or not plugin.version:
            raise ValueError("a plug-in needs a name and a version")
        if plugin.name in self._plugins:
            raise ValueError(f"{plugin.name} is registered already")
        self._plugins[plugin.name] = plugin

    def unregister(self, name: str) -> bool:
        return self._plugins.pop(name, None) is not None

    def get(self, name: str) -> Plugin | None:
        return self._plugins.get(name)

    def list(self, type: str | None = None) -> list[Plugin]:
        return [p for p in self._plugins.values() if type in (None, p.type)]

    def start(self, name: str, **options: Any) -> Any:
        """Make the plug-in's object; a failure is kept in its errors."""
        p = self._plugins[name]
        if missing := [n for n in p.needs if n not in self._plugins]:
            p.status = "failed"
            p.errors.append(f"missing {missing}")
            raise ValueError(p.errors[-1])
        try:
            made = p.make(**options)
        except Exception as e:
            p.status = "failed"
            p.errors.append(str(e))
            raise
        p.status = "running"
        return made

    def stop(self, name: str) -> None:
        self._plugins[name].status = "stopped"

    def load(self, target: str) -> Plugin:
        """Register ``module:attribute``, a Plugin that can be imported."""
        module, _, attribute = target.partition(":")
        plugin = getattr(importlib.import_module(module), attribute)
        self.register(plugin)
        return plugin
