"""A15, C13. Settings from the environment: a malformed number gives the default and an error that blocks."""

from __future__ import annotations

import shlex
from collections.abc import Mapping
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

from ..schemas import ConfigError


@dataclass
class Settings:
    """Reads numbers, globs and flags of an environment and keeps what was wrong with them."""

    env: Mapping[str, str]
    errors: list[str] = field(default_factory=list)

    def number(self, name: str, default: float, kind: type = int, least: float | None = None):
        raw = self.env.get(name)
        if raw is None or not raw.strip():
            return kind(default)
        try:
            value = kind(raw)
            if value != value or value in (float("inf"), float("-inf")):
                raise ValueError
        except ValueError:
            self.errors.append(f"{name} must be a finite {kind.__name__}, got {raw!r}; using {default}")
            return kind(default)
        if least is not None and value < least:
            self.errors.append(f"{name} must be at least {least}, got {raw!r}; using {default}")
            return kind(default)
        return value

    def globs(self, name: str) -> list[str]:
        return [p.strip() for p in (self.env.get(name) or "").split(",") if p.strip()]

    def flags(self, name: str) -> list[str]:
        """Words as a shell splits them; an unbalanced quotation raises."""
        try:
            return shlex.split(self.env.get(name) or "")
        except ValueError as e:
            raise ConfigError(f"{name}: {e}") from e

    def check_budget(self, attempt_s: float, total_s: float) -> None:
        """C13. One attempt must fit into the whole."""
        if attempt_s > total_s:
            self.errors.append(f"one attempt needs {attempt_s:g} s, but all checks of a turn have {total_s:g} s: no unit would ever start")

    @property
    def blocks(self) -> bool:
        return bool(self.errors)


@contextmanager
def session(spark: SparkSession, wanted: dict[str, str]):
    """The session with these settings for a while; what starts meanwhile, streams too, keeps them."""
    before = {key: spark.conf.get(key, None) for key in wanted}
    try:
        for key, value in wanted.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
