"""Settings of the engine."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, fields, replace

from assetloom.functions.text import INTENDED, OBSERVED


@dataclass(frozen=True)
class EngineConfig:
    """Defaults hold unless a JSON file, the environment or Spark's settings say otherwise, each before the next."""

    quirks: str = INTENDED
    heuristic_bytes: int = 8192
    capture_html: bool = True
    only_in_scope: bool = False
    beautify: bool = True
    always_beautify: bool = False
    sourcemaps: bool = True
    chunk_discovery: bool = True
    chunk_limit: int = 40
    queue_limit: int = 200
    redact_secrets: bool = False
    debounce: str = "500 milliseconds"

    def __post_init__(self) -> None:
        if self.quirks not in (INTENDED, OBSERVED):
            raise ValueError(f"quirks must be {INTENDED} or {OBSERVED}")

    @classmethod
    def load(cls, path: str | None = None, env: dict[str, str] | None = None, spark=None) -> EngineConfig:
        """From a JSON file, then ASSETLOOM_<NAME> in the environment, then spark.assetloom.<name>."""
        given: dict[str, object] = {}
        kinds = {f.name: f.type for f in fields(cls)}
        if path and os.path.exists(path):
            with open(path) as file:
                given |= {k: v for k, v in json.load(file).items() if k in kinds}
        env = dict(os.environ) if env is None else env
        given |= {k: env[f"ASSETLOOM_{k.upper()}"] for k in kinds if f"ASSETLOOM_{k.upper()}" in env}
        if spark is not None:
            given |= {k: v for k in kinds if (v := spark.conf.get(f"spark.assetloom.{k}", None)) is not None}

        def typed(kind: str, value: object) -> object:
            if kind == "bool":
                return value if isinstance(value, bool) else str(value).lower() in ("1", "true", "yes", "on")
            return int(str(value)) if kind == "int" else str(value)

        return replace(cls(), **{k: typed(kinds[k], v) for k, v in given.items()})
