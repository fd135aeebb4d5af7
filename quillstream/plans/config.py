"""Configuration: defaults < user file < nearest directory file < explicit overrides."""

from __future__ import annotations

from functools import lru_cache
from pathlib import Path

import yaml

from quillstream.errors import ConfigError

DEFAULTS = {"output": {"directory": None, "filename_pattern": "{name}.{ext}", "overwrite": False}, "documents": {"encoding": "utf-8", "title_from_filename": False}}
FILE = "quillstream.yaml"
USER = Path(".quillstream") / "config.yaml"  # in the home folder


def merge(base: dict, update: dict) -> dict:
    """A deep merge; the second wins, also where it has null."""
    out = dict(base)
    for k, v in update.items():
        out[k] = merge(out[k], v) if isinstance(out.get(k), dict) and isinstance(v, dict) else v
    return out


@lru_cache(4096)
def parsed(text: str) -> dict:
    """The values of a YAML text; equal texts share them, so they aren't to be changed."""
    return yaml.safe_load(text) or {}


def load(path: str | Path) -> dict:
    try:
        values = yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}
    except (OSError, yaml.YAMLError) as e:
        raise ConfigError(f"{path}: {e}") from e
    if not isinstance(values, dict):
        raise ConfigError(f"{path}: not a mapping")
    return values


def user_values() -> dict:
    """The user's own file, if there is one."""
    return load(Path.home() / USER) if (Path.home() / USER).is_file() else {}


def nearest(source: str | Path) -> Path | None:
    """The configuration file of the nearest directory at or above a source, up to the home folder."""
    for d in Path(source).resolve().parents:
        if (d / FILE).is_file():
            return d / FILE
        if d == Path.home():
            break
    return None


class Config:
    """Values by dotted key. Unlike layers merged in place, each source file gets its own result."""

    def __init__(self, user: dict | None = None, overrides: dict | None = None):
        self.user, self.overrides = user_values() if user is None else user, overrides or {}

    def resolve(self, source: str | Path | None = None) -> dict:
        out = merge(DEFAULTS, self.user)
        if source is not None and (at := nearest(source)):
            out = merge(out, load(at))
        return merge(out, self.overrides)

    def get(self, key: str, default=None, source: str | Path | None = None):
        at = self.resolve(source)
        for k in key.split("."):
            if not isinstance(at, dict) or k not in at:
                return default
            at = at[k]
        return at


def dotted(values: dict, prefix: str = "") -> dict:
    """A nested dict as dotted keys."""
    out: dict = {}
    for k, v in values.items():
        out |= dotted(v, f"{prefix}{k}.") if isinstance(v, dict) else {f"{prefix}{k}": v}
    return out


def write_default(path: str | Path) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(yaml.safe_dump(DEFAULTS, sort_keys=False), encoding="utf-8")
