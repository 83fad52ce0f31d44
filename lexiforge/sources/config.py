"""Run settings: top level, overlaid by a mode, then by what the caller gives."""

from __future__ import annotations

import json


def overlaid(base: dict, over: dict) -> dict:
    out = dict(base)
    for k, v in over.items():
        out[k] = overlaid(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def settings(config: dict | None, mode: str | None = None) -> dict:
    config = config or {}
    base = {k: v for k, v in config.items() if k != "modes"}
    over = (config.get("modes") or {}).get(mode)
    return overlaid(base, over) if isinstance(over, dict) else base


def read_config(path: str | None, mode: str | None = "full") -> dict:
    """The settings of a YAML or JSON file (none without a path); an error if the file is missing."""
    if path is None:
        return {}
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if path.endswith(".json"):
        return settings(json.loads(text or "{}"), mode)
    import yaml

    return settings(yaml.safe_load(text), mode)


def pick(given, config: dict, key: str, default=None):
    return given if given is not None else config.get(key, default)
