"""Settings: YAML files, overrides, method and mode names, required keys."""

from __future__ import annotations

import os

try:
    import yaml
except ImportError:
    yaml = None


def value_of(text: str):
    """A value as YAML reads it (without YAML: numbers, booleans and null)."""
    if yaml:
        return yaml.safe_load(text)
    plain = {"true": True, "false": False, "null": None, "": None}
    if text.lower() in plain:
        return plain[text.lower()]
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            continue
    return text


def load(path: str) -> dict:
    if yaml is None:
        raise RuntimeError("PyYAML is needed to read settings files")
    with open(path, encoding="utf-8") as lines:
        held = yaml.safe_load(lines)
    if not held:
        raise ValueError(f"empty settings file: {os.path.basename(path)}")
    return held


def overridden(config: dict, overrides: list[str], strict: bool = False) -> dict:
    """config with 'a.b=value' settings applied; strict: only keys that exist can be set."""
    out = {k: (overridden(v, []) if isinstance(v, dict) else v) for k, v in config.items()}
    for item in overrides:
        if "=" not in item:
            raise ValueError(f"not a.b=value: {item}")
        path, _, text = item.partition("=")
        *parents, last = path.split(".")
        at = out
        for key in parents:
            if strict and not isinstance(at.get(key), dict):
                raise ValueError(f"unknown setting: {path}")
            at = at.setdefault(key, {})
        if strict and last not in at:
            raise ValueError(f"unknown setting: {path}")
        at[last] = value_of(text)
    return out


def required(config: dict, keys: list[str]) -> dict:
    lost = [k for k in keys if config.get(k) in (None, "")]
    if lost:
        raise ValueError(f"missing settings: {', '.join(lost)}")
    return config
