"""Named options with typed getters, sizes with units, and options of one of several inputs."""

from __future__ import annotations

import re
from collections.abc import Mapping

_UNITS = {"": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30, "t": 1 << 40}


class Options(Mapping):
    """Values by name, names in any case. Text is read as the getter asks."""

    def __init__(self, *parts: Mapping, **more):
        self._held = {str(k).lower(): v for part in (*parts, more) for k, v in part.items()}

    def __getitem__(self, key: str):
        return self._held[key.lower()]

    def __iter__(self):
        return iter(self._held)

    def __len__(self) -> int:
        return len(self._held)

    def text(self, key: str, default: str | None = None) -> str | None:
        v = self._held.get(key.lower())
        return default if v is None else str(v)

    def integer(self, key: str, default: int | None = None) -> int | None:
        v = self.text(key)
        return default if v is None else int(v)

    def number(self, key: str, default: float | None = None) -> float | None:
        v = self.text(key)
        return default if v is None else float(v)

    def flag(self, key: str, default: bool = False) -> bool:
        v = self.text(key)
        return default if v is None else v.strip().lower() in ("true", "yes", "on", "1", "")

    def size(self, key: str, default: int | None = None) -> int | None:
        """Bytes of a text such as 32m or 1.5g."""
        v = self.text(key)
        if v is None:
            return default
        m = re.fullmatch(r"\s*(\d+(?:\.\d+)?)\s*([kmgt]?)b?\s*", v.lower())
        if not m:
            raise ValueError(f"not a size: {v!r}")
        return int(float(m[1]) * _UNITS[m[2]])

    def of_input(self, index: int) -> Options:
        """Options of one input: name[index] stands before name."""
        plain = {k: v for k, v in self._held.items() if not re.search(r"\[\d+\]$", k)}
        own = {k[: k.rindex("[")]: v for k, v in self._held.items() if k.endswith(f"[{index}]")}
        return Options(plain, own)
