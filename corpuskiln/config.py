"""Settings of an index, from a TOML file and the environment."""

from __future__ import annotations

import os
import tomllib
from dataclasses import asdict, dataclass, field, fields, replace


@dataclass(frozen=True)
class Config:
    """Defaults are fixed values that queries rely on."""

    chunk_size: int = 512
    chunk_overlap: int = 50
    embedding_dim: int = 1024
    embedding_url: str = "http://localhost:11434"
    embedding_model: str = "bge-m3"
    hybrid_search: bool = False
    relevance_threshold: float | None = None
    reranker: bool = False
    watched_paths: list[str] = field(default_factory=list)

    def to_toml(self) -> str:
        plain = lambda v: str(v).lower() if isinstance(v, bool) else "[" + ", ".join(map(plain, v)) + "]" if isinstance(v, list) else str(v) if isinstance(v, int | float) else '"' + v.replace("\\", "\\\\").replace('"', '\\"') + '"'
        return "".join(f"{k} = {plain(v)}\n" for k, v in asdict(self).items() if v is not None)

    @classmethod
    def from_toml(cls, text: str, environment: dict[str, str] | None = None) -> Config:
        """Unknown keys are left out; KILN_<NAME> in the environment overrides strings and numbers."""
        given, names = tomllib.loads(text), {f.name for f in fields(cls)}
        out = cls(**{k: v for k, v in given.items() if k in names})
        env = os.environ if environment is None else environment
        over = {k: type(v)(env[f"KILN_{k.upper()}"]) for k, v in asdict(out).items() if f"KILN_{k.upper()}" in env and type(v) in (str, int, float)}
        return replace(out, **over)
