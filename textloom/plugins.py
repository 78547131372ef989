"""Analyzers from files, modules and entry points."""

from __future__ import annotations

import importlib
import importlib.util
import inspect
import warnings
from importlib.metadata import entry_points
from pathlib import Path
from types import ModuleType

from textloom.config import Config
from textloom.plans.analyzers import Analyzer, ChunkRuleAnalyzer

ENTRY_POINTS = "textloom.analyzers"


def _classes(module: ModuleType) -> list[type[Analyzer]]:
    """Those in the module's list ANALYZERS, or else all that it defines."""
    if (listed := getattr(module, "ANALYZERS", None)) is not None:
        return [c for c in map(_as_class, listed) if c]
    return [c for c in vars(module).values() if inspect.isclass(c) and issubclass(c, Analyzer) and not inspect.isabstract(c) and c is not ChunkRuleAnalyzer and c.__module__ == module.__name__]


def _as_class(value: object) -> type[Analyzer] | None:
    if inspect.isclass(value) and issubclass(value, Analyzer):
        return value
    return type(value) if isinstance(value, Analyzer) else None


def _from_file(path: Path) -> list[type[Analyzer]]:
    spec = importlib.util.spec_from_file_location(f"textloom_plugin_{path.stem}", path)
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return _classes(module)


def load(name: str) -> list[type[Analyzer]]:
    """By the path of a Python file, or by the name of a module."""
    return _from_file(Path(name)) if name.endswith(".py") else _classes(importlib.import_module(name))


def load_all(config: Config) -> list[type[Analyzer]]:
    """In order, each once: plugins of the settings, then entry points. A broken one is left out with a warning."""
    found: list[type[Analyzer]] = []
    for name in config.plugins:
        try:
            found += load(name)
        except Exception as e:
            warnings.warn(f"plugin {name!r} can't be loaded: {e}", stacklevel=2)
    for point in entry_points(group=ENTRY_POINTS):
        try:
            value = point.load()
            found += _classes(value) if isinstance(value, ModuleType) else [c for c in [_as_class(value)] if c]
        except Exception as e:
            warnings.warn(f"plugin {point.name!r} can't be loaded: {e}", stacklevel=2)
    unique = {(c.__module__, c.__qualname__): c for c in reversed(found)}
    return list(dict.fromkeys(unique[c.__module__, c.__qualname__] for c in found))
