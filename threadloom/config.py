"""Settings of a run from a file and the environment: file, then variables THREADLOOM__SECTION__KEY, merged key by key."""

from __future__ import annotations

import dataclasses
import json
import os
import tomllib
from collections.abc import Mapping
from pathlib import Path
from typing import Any, get_args, get_origin, get_type_hints

PREFIX = "THREADLOOM"


def merged(base: Mapping[str, Any], over: Mapping[str, Any]) -> dict[str, Any]:
    """base with over's values; sections are merged, not replaced."""
    out = dict(base)
    for k, v in over.items():
        out[k] = merged(out[k], v) if isinstance(v, Mapping) and isinstance(out.get(k), Mapping) else v
    return out


def from_environment(env: Mapping[str, str], prefix: str = PREFIX) -> dict[str, Any]:
    out: dict[str, Any] = {}
    for name, value in env.items():
        head, *keys = name.split("__")
        if head == prefix and keys and all(keys):
            at = out
            for k in keys[:-1]:
                at = at.setdefault(k.lower(), {})
            at[keys[-1].lower()] = value
    return out


def read_file(path: str | Path) -> dict[str, Any]:
    """A JSON, TOML or, where a reader for it is installed, YAML file; a missing file has no settings."""
    p = Path(path)
    if not p.exists():
        return {}
    text = p.read_text(encoding="utf-8")
    if p.suffix == ".json":
        return json.loads(text)
    if p.suffix == ".toml":
        return tomllib.loads(text)
    try:
        import yaml
    except ImportError as e:
        raise ValueError(f"{p.name}: no reader for {p.suffix} is installed; use .json or .toml") from e
    return yaml.safe_load(text) or {}


def env_file(path: str | Path) -> dict[str, str]:
    """NAME=value lines of a file; comments and blank lines are skipped, quotes around a value go."""
    p = Path(path)
    pairs = (l.partition("=") for l in p.read_text(encoding="utf-8").splitlines() if "=" in l and not l.lstrip().startswith("#")) if p.exists() else ()
    return {k.strip(): v.strip().strip("\"'") for k, _, v in pairs}


def _typed(value: Any, kind: Any) -> Any:
    """A setting as its field's type; texts from the environment are read as that type."""
    options = [a for a in get_args(kind) if a is not type(None)]
    if get_origin(kind) is not tuple and options and value is not None:
        kind = options[0]
    if value is None or (isinstance(value, str) and value.lower() in ("", "none", "null") and kind is not str):
        return None
    if get_origin(kind) is tuple or kind is tuple:
        return tuple(x.strip() for x in value.split(",") if x.strip()) if isinstance(value, str) else tuple(value)
    if kind is bool:
        if isinstance(value, str) and value.lower() not in ("1", "0", "true", "false", "yes", "no", "on", "off"):
            raise ValueError(f"{value} is no yes or no")
        return value.lower() in ("1", "true", "yes", "on") if isinstance(value, str) else bool(value)
    return kind(value) if kind in (int, float, str) else value


def as_dataclass(cls: type, settings: Mapping[str, Any]) -> Any:
    """An instance of a dataclass; unknown settings are an error."""
    kinds = get_type_hints(cls)
    unknown = set(settings) - {f.name for f in dataclasses.fields(cls)}
    if unknown:
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    return cls(**{k: _typed(v, kinds[k]) for k, v in settings.items()})


def load(cls: type, path: str | Path | None = None, section: str = "pipeline", dotenv: str | Path | None = None, env: Mapping[str, str] | None = None) -> Any:
    """cls from a file's section, overridden by a .env file and that by the environment."""
    settings = read_file(path) if path else {}
    settings = merged(settings, from_environment(env_file(dotenv) if dotenv else {}))
    settings = merged(settings, from_environment(os.environ if env is None else env))
    return as_dataclass(cls, settings.get(section, {}))
