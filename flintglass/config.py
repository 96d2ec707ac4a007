"""Settings: defaults, with a TOML file merged over them."""

from __future__ import annotations

import json
import tomllib
from pathlib import Path

DEFAULTS = {"reports": {"folder": "reports", "formats": ["txt", "json", "html", "csv"], "retention_days": 30}, "scan": {"recursive": True, "hash": True, "context": True, "confidence_threshold": 0.0, "entropy_threshold": 7.5, "strict": False}, "schedule": {"hour": 2, "minute": 0}}


def load(path: str | None = None) -> dict:
    """Unknown sections are kept; a missing file gives the defaults."""
    out = {k: dict(v) for k, v in DEFAULTS.items()}
    if path and Path(path).exists():
        for section, values in tomllib.loads(Path(path).read_text()).items():
            out[section] = {**out.get(section, {}), **values} if isinstance(values, dict) else values
    return out


def text(settings: dict) -> str:
    """Settings as TOML."""
    value = lambda v: json.dumps(v, ensure_ascii=False)  # noqa: E731 - numbers, texts, booleans and lists of them are written alike in both
    return "\n".join("\n".join([f"[{section}]", *(f"{k} = {value(v)}" for k, v in values.items()), ""]) for section, values in settings.items() if isinstance(values, dict))


def change(path: str | None, changes: list[str] = ()) -> dict:
    """Writes a file of settings, with changes of the form section.key=value made; a value is read as JSON, else as text. A setting that isn't known raises."""
    settings = load(path)
    for c in changes:
        name, _, value = c.partition("=")
        section, _, key = name.partition(".")
        if key not in DEFAULTS.get(section, {}):
            raise ValueError(f"unknown setting: {name}")
        try:
            made = json.loads(value)
        except ValueError:
            made = value
        if type(made) is not type(DEFAULTS[section][key]) and not (isinstance(made, int | float) and isinstance(DEFAULTS[section][key], float)):
            raise ValueError(f"not a value for {name}: {value}")
        settings[section][key] = made
    if path:
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        new = Path(f"{path}.new")
        new.write_text(text(settings))
        new.replace(path)
    return settings
