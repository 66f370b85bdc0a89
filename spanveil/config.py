"""Engine settings, read once on the driver."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class EngineConfig:
    """Values that the operators take as literals; fail-closed defaults."""

    threshold: float = 0.5
    model_floor: float = 0.15
    bbox_pad_chars: float = 0.6
    bbox_pad_lines: float = 0.08
    model_chunk_chars: int = 8000
    max_bytes: int = 20 * 1024 * 1024
    max_pages: int = 50
    window_stride: int = 12_000
    window_halo: int = 1_000
    part_chars: int = 100_000
    min_side: int = 800
    min_chars: int = 20
    min_confidence: float = 0.65
    caps_retry: bool = True
    mode: str = "rules"

    @classmethod
    def from_env(cls, env: Mapping[str, str] | None = None, prefix: str = "SPANVEIL_") -> EngineConfig:
        """Settings from the environment; what cannot be read as the field's type keeps its default, as does a blank."""
        env = os.environ if env is None else env
        found = {}
        for f in fields(cls):
            raw = (env.get(prefix + f.name.upper()) or "").strip()
            if not raw:
                continue
            kind = type(f.default)
            if kind is bool:
                found[f.name] = raw.lower() in ("1", "true", "yes", "on")
                continue
            try:
                found[f.name] = kind(raw)
            except ValueError:
                pass
        return cls(**found)
