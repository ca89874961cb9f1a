"""Site configuration and rule files, read on the driver."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, fields


@dataclass
class SiteConfig:
    """One site's settings; unknown keys of a file are ignored, missing ones keep their defaults."""

    site_name: str = "site"
    data_directory: str = "."
    filetype: str = "parquet"
    timezone: str = "UTC"
    repeat_window_hours: float = 48.0
    external_table: str | None = None
    rebuild: tuple[str, ...] = ()
    state_machine: bool = True

    @classmethod
    def read(cls, path: str, environment: dict[str, str] | None = None) -> SiteConfig:
        """Settings of a JSON file; variables named CHRONOWARD_<SETTING> go before it."""
        with open(path) as f:
            found = json.load(f)
        environment = os.environ if environment is None else environment
        values = {}
        for x in fields(cls):
            raw = environment.get(f"CHRONOWARD_{x.name.upper()}", found.get(x.name, x.default))
            if isinstance(x.default, bool) and isinstance(raw, str):
                raw = raw.lower() in ("1", "true", "yes")
            elif isinstance(x.default, float):
                raw = float(raw)
            elif isinstance(x.default, tuple):
                raw = tuple(raw.split(",")) if isinstance(raw, str) else tuple(raw)
            values[x.name] = raw
        return cls(**values)

    def path(self, table: str) -> str:
        return f"{self.data_directory.rstrip('/')}/{table}.{self.filetype}"


def read_rules(path: str) -> dict[str, dict]:
    """Plausible ranges of a YAML or JSON file as {table or group: rule}, a pair [low, high] meaning {min, max}."""
    with open(path) as f:
        text = f.read()
    if path.endswith((".yaml", ".yml")):
        try:
            import yaml
        except ImportError as e:
            raise RuntimeError("YAML rule files need PyYAML; JSON ones do not") from e
        found = yaml.safe_load(text)
    else:
        found = json.loads(text)
    return {name: tidy(rule, name) for name, rule in found.get("tables", found).items()}


def tidy(rule, name: str):
    if isinstance(rule, list):
        if len(rule) != 2:
            raise ValueError(f"{name}: a range is a pair")
        return {"min": float(rule[0]), "max": float(rule[1])}
    if not isinstance(rule, dict):
        raise ValueError(f"{name}: neither a range nor a mapping")
    if set(rule) == {"min", "max"}:
        return {k: float(v) for k, v in rule.items()}
    return {k: tidy(v, f"{name}.{k}") for k, v in rule.items()}
