"""Options of a table build, from arguments or from environment variables."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields, replace

MODES = {"hybrid": "hybrid", "default": "hybrid", "block": "block", "block_truncated": "block", "sliding": "sliding"}
PREFIX = "GRIDMOMENTS_"


def checked_mode(mode: str) -> str:
    try:
        return MODES[mode.strip().lower()]
    except KeyError:
        raise ValueError(f"unknown coarsening mode {mode!r}; use hybrid, block or sliding") from None


def parse_bool(text: str | None, default: bool) -> bool:
    return default if not (text or "").strip() else text.strip().lower() in ("1", "true", "yes", "y", "on")


def parse_ints(text: str | None, default: list[int]) -> list[int]:
    parts = [p.strip() for p in (text or "").split(",") if p.strip()]
    return [int(p) for p in parts] if parts else default


@dataclass(frozen=True)
class BuildOptions:
    coarsening_mode: str = "hybrid"
    check_finite: bool = True
    min_h: float = 200.0
    max_dz: float = 400.0
    outputs_h: int = 2
    outputs_v: int = 2
    outputs_z: int = 2
    stride_h: int | None = None
    stride_v: int | None = None
    stride_z: int | None = None
    budget: int = 10

    def __post_init__(self) -> None:
        object.__setattr__(self, "coarsening_mode", checked_mode(self.coarsening_mode))

    def placing(self) -> tuple[tuple[int, int, int], tuple[int | None, int | None, int | None]]:
        """Windows' outputs and strides along x, y and z."""
        return (self.outputs_h, self.outputs_v, self.outputs_z), (self.stride_h, self.stride_v, self.stride_z)

    def having(self, **changes: object) -> BuildOptions:
        return replace(self, **changes)

    def summary(self) -> str:
        return "BuildOptions: " + ", ".join(f"{f.name}={getattr(self, f.name)}" for f in fields(self))

    @classmethod
    def from_env(cls, env: Mapping[str, str] = os.environ, **changes: object) -> BuildOptions:
        read: dict[str, object] = {}
        for f in fields(cls):
            text = env.get(PREFIX + f.name.upper())
            if text is None or not text.strip():
                continue
            kind = type(f.default)
            read[f.name] = parse_bool(text, f.default) if kind is bool else int(text) if kind is int or f.default is None else float(text) if kind is float else text
            if f.name.startswith("outputs") or f.name == "budget":
                read[f.name] = max(1, read[f.name])
        return cls(**(read | changes))
