"""Hierarchical configuration: a file may extend another; its own values win, mappings are merged."""

from __future__ import annotations

import json
import os
from pathlib import Path
from typing import Any

try:
    import yaml
except ModuleNotFoundError:  # then files must be JSON
    yaml = None

ENVIRONMENT, DEFAULT = "CONFIG_PATH", "/config/base.yml"


def over(low: dict[str, Any], high: dict[str, Any]) -> dict[str, Any]:
    """``high`` laid over ``low``."""
    nested = {k: over(low[k], v) for k, v in high.items() if isinstance(v, dict) and isinstance(low.get(k), dict)}
    return {**low, **high, **nested}


def _parsed(path: Path) -> dict[str, Any]:
    text = path.read_text(encoding="utf-8")
    if path.suffix == ".json" or yaml is None:
        return json.loads(text or "{}")
    return yaml.safe_load(text) or {}


def load(path: str | Path | None = None) -> dict[str, Any]:
    """The file, or the one that the environment names, with all that it extends."""
    at = Path(path or os.environ.get(ENVIRONMENT, DEFAULT)).resolve()
    chain: list[Path] = []
    layers: list[dict[str, Any]] = []
    while True:
        if at in chain:
            raise ValueError("configuration extends itself: " + " -> ".join(map(str, [*chain, at])))
        chain.append(at)
        layer = _parsed(at)
        parent = layer.pop("extends", None)
        layers.append(layer)
        if parent is None:
            break
        at = (at.parent / parent).resolve()
    merged: dict[str, Any] = {}
    for layer in reversed(layers):
        merged = over(merged, layer)
    return merged


def write_runtime(folder: str | Path, label: str, base: str | Path, values: dict[str, Any]) -> Path:
    """A file in ``folder`` that extends ``base`` with ``values`` (such as which dashboards are fed), for one run; its path."""
    folder = Path(folder)
    folder.mkdir(parents=True, exist_ok=True)
    safe = "".join(c if c.isascii() and (c.isalnum() or c in "_.-") else "_" for c in label)
    at = folder / f"{safe}.full-flow.yml"
    # JSON is YAML too
    at.write_text(json.dumps({"extends": os.path.relpath(Path(base).resolve(), folder.resolve()), **values}, indent=2) + "\n", encoding="utf-8")
    return at
