"""Settings of a run (SRC9-SRC11): values from the session or the environment, folders by preference, optional JSON."""

from __future__ import annotations

import json
import os
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import SparkSession

from .records import first_existing

#: Spellings of yes, and of no limit.
YES, NO_LIMIT = ("1", "true", "yes", "y", "on"), ("none", "null", "-1")


@dataclass(frozen=True)
class Settings:
    """Reads `prefix + name` from the session's configuration, else the variable `name` of the environment; a blank value means the default."""

    spark: SparkSession | None = None
    prefix: str = "spark.abacora."

    def text(self, name: str, default: str) -> str:
        said = self.spark.conf.get(self.prefix + name.lower(), None) if self.spark else None
        said = os.environ.get(name) if said is None else said
        return said.strip() if said else default

    def flag(self, name: str, default: bool) -> bool:
        said = self.text(name, "")
        return said.lower() in YES if said else default

    def number(self, name: str, default: float) -> float:
        said = self.text(name, "")
        return float(said) if said else default

    def whole(self, name: str, default: int) -> int:
        said = self.text(name, "")
        return int(said) if said else default

    def limit(self, name: str, default: int | None) -> int | None:
        """A whole number, or None where the value says that there is no limit."""
        said = self.text(name, "")
        if not said:
            return default
        return None if said.lower() in NO_LIMIT else int(said)


def resolve_folder(override: str | None, candidates: Iterable[str]) -> str:
    """The override if one is given, else the first candidate that exists; nothing is downloaded."""
    return first_existing(*([override] if override else candidates))


def json_if_there(path: str) -> dict:
    """A small JSON file of the driver; an empty dict if there is none."""
    if not os.path.exists(path):
        return {}
    with open(path, encoding="utf-8") as file:
        return json.load(file)
