"""Settings: files that build on each other, deep merges, command-line overrides.  On the driver only."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from copy import deepcopy
from pathlib import Path
from typing import Any


def merge(base: Mapping, over: Mapping) -> dict:
    """``over`` on top of ``base``; mappings merge key by key, anything else is replaced."""
    out = deepcopy(dict(base))
    for key, value in over.items():
        out[key] = merge(out[key], value) if isinstance(value, Mapping) and isinstance(out.get(key), Mapping) else deepcopy(value)
    return out


def _read(path: Path) -> dict:
    text = path.read_text(encoding="utf-8")
    if path.suffix == ".json":
        return json.loads(text)
    try:
        import yaml
    except ImportError as error:
        raise RuntimeError(f"{path}: reading YAML needs a YAML library") from error
    return yaml.safe_load(text) or {}


def load(path: str | Path, overrides: Sequence[str] = (), _above: tuple[Path, ...] = ()) -> dict:
    """A file merged over the files its ``defaults`` names (relative to it), then ``a.b=value`` overrides (values as JSON if they parse)."""
    path = Path(path).resolve()
    if path in _above:
        raise ValueError(f"circular defaults: {path}")
    own = _read(path)
    names = own.pop("defaults", [])
    out: dict = {}
    for name in [names] if isinstance(names, str) else names:
        out = merge(out, load(path.parent / name, (), (*_above, path)))
    out = merge(out, own)
    for item in overrides:
        key, found, value = item.partition("=")
        if not found:
            raise ValueError(f"not a key=value override: {item}")
        out = merge(out, _nested(key.split("."), _value(value)))
    return out


def _value(text: str) -> Any:
    try:
        return json.loads(text)
    except ValueError:
        return text


def _nested(keys: Sequence[str], value: Any) -> dict:
    for key in reversed(keys):
        value = {key: value}
    return value


def get(config: Mapping, dotted: str, default: Any = None) -> Any:
    for key in dotted.split("."):
        if not isinstance(config, Mapping) or key not in config:
            return default
        config = config[key]
    return config
