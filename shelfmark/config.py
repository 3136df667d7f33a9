"""Settings: environment files, servers and providers. Plain values on the driver, no tables."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field


def read_env(lines: str) -> dict[str, str]:
    """KEY=value lines; comments, ``export`` and quotes around values go."""
    out = {}
    for line in lines.splitlines():
        line = line.strip().removeprefix("export ").strip()
        if line and not line.startswith("#") and "=" in line:
            k, v = line.split("=", 1)
            v = v.strip()
            out[k.strip()] = v[1:-1] if len(v) > 1 and v[0] == v[-1] and v[0] in "\"'" else v
    return out


def resolve(value, env: dict[str, str] | None = None):
    """${NAME} and ${NAME:-other} in strings, lists and dicts."""
    env = os.environ if env is None else env
    if isinstance(value, dict):
        return {k: resolve(v, env) for k, v in value.items()}
    if isinstance(value, list):
        return [resolve(v, env) for v in value]
    if isinstance(value, str):
        return re.sub(r"\$\{(\w+)(?::-([^}]*))?\}", lambda m: env.get(m[1]) or m[2] or "", value)
    return value


@dataclass
class Server:
    name: str
    transport: str = "stdio"
    url: str = ""
    writable: bool = False
    requires: list[str] = field(default_factory=list)

    def missing(self, env: dict[str, str]) -> list[str]:
        return [x for x in self.requires if not env.get(x)]

    def can_write(self, env: dict[str, str]) -> bool:
        """What the address says about reading only counts more than the setting."""
        m = re.search(r"[?&]read_only=(\w+)", resolve(self.url, env))
        return m[1].lower() not in ("1", "true", "yes") if m else self.writable


@dataclass
class Provider:
    name: str
    family: str
    env_key: str
    default_model: str

    def configured(self, env: dict[str, str]) -> bool:
        return bool(env.get(self.env_key))


def first_configured(providers: list[Provider], env: dict[str, str]) -> Provider | None:
    return next((p for p in providers if p.configured(env)), None)


def judge_panel(providers: list[Provider], generator: str, env: dict[str, str], most: int = 6) -> list[Provider]:
    """One configured provider of each family other than the generator's, in order."""
    own = next((p.family for p in providers if p.name == generator), None)
    seen, out = {own}, []
    for p in providers:
        if p.configured(env) and p.family not in seen:
            seen.add(p.family)
            out.append(p)
    return out[:most]


def clamp(value: int, low: int, high: int) -> int:
    return max(low, min(high, value))


def chunk_options(size: int, overlap: int) -> tuple[int, int]:
    size = clamp(size, 200, 4000)
    return size, clamp(overlap, 0, size // 2)
