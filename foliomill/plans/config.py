"""Settings of a run from the environment, with their bounds."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, field

#: Least values that are taken as they are.
LEAST = {"rpm": 1, "rpd": 0, "max_chars": 2000, "segment_chars": 1500, "context_chars": 0}


@dataclass(frozen=True)
class Config:
    target_language: str = "es"
    model: str = ""
    api_key: str = field(default="", repr=False)
    rpm: int = 10
    rpd: int = 0
    max_chars: int = 24_000
    segment_chars: int = 6_000
    context_chars: int = 1_500
    temperature: float = 0.3
    bilingual: bool = False


def load(env: Mapping[str, str] | None = None, prefix: str = "FOLIOMILL_") -> Config:
    """Values of ``prefix`` + NAME; a value of the wrong type raises, a number below its bound is raised to it."""
    env = os.environ if env is None else env
    values = {}
    for name, default in ((f.name, f.default) for f in Config.__dataclass_fields__.values()):
        raw = env.get(prefix + name.upper(), "").strip()
        if not raw:
            continue
        try:
            value = raw.lower() in ("1", "true", "yes", "on") if isinstance(default, bool) else type(default)(raw)
        except ValueError as e:
            raise ValueError(f"{prefix}{name.upper()} must be {type(default).__name__}, not {raw!r}") from e
        values[name] = max(LEAST[name], value) if name in LEAST else value
    return Config(**values)
