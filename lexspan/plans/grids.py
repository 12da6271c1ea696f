"""Parameter grids and the parsers of their command-line forms."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

#: The grid of decoder parameters, and the endpoints that paired tests contrast.
TOP_K = [*range(1, 21), *range(25, 81, 5)]
TOP_P = [0.50, 0.55, 0.60, 0.65, 0.70, 0.75, 0.80, 0.85, 0.90, 0.95, 0.99]
MIN_P = [0.01, 0.02, 0.03, 0.04, 0.05, 0.06, 0.07, 0.08, 0.09, 0.10]
ENDPOINTS = [("top_k", 10.0, 80.0), ("top_p", 0.8, 0.99), ("min_p", 0.1, 0.01)]
GRID_SCHEMA = "decoder string, parameter double"


@dataclass(frozen=True)
class Recipe:
    name: str
    top_k: int
    top_p: float

    def __post_init__(self):
        if self.top_k < 1 or not 0 < self.top_p <= 1:
            raise ValueError(f"top_k must be 1 or more and top_p in (0, 1]: {self}")


@dataclass(frozen=True)
class Stratum:
    low: int
    high: int
    count: int

    def __post_init__(self):
        if not (1 <= self.low <= self.high and self.count >= 1):
            raise ValueError(f"a stratum needs 1 <= low <= high and a count of 1 or more: {self}")


def grid_rows(top_k: list[int] = TOP_K, top_p: list[float] = TOP_P, min_p: list[float] = MIN_P) -> list[tuple[str, float]]:
    return [("top_k", float(k)) for k in top_k] + [("top_p", p) for p in top_p] + [("min_p", m) for m in min_p]


def grid(spark: SparkSession, rows: list[tuple[str, float]] | None = None) -> DataFrame:
    return spark.createDataFrame(rows or grid_rows(), GRID_SCHEMA)


def parse_numbers(text: str, kind: type = float) -> list:
    """Comma-separated numbers; ValueError if there are none."""
    values = [kind(x) for x in text.split(",") if x.strip()]
    if not values:
        raise ValueError(f"no numbers in {text!r}")
    return values


def parse_temperatures(text: str) -> list[float]:
    values = parse_numbers(text)
    if any(t <= 0 for t in values):
        raise ValueError("temperatures must be positive")
    return values


def _fields(pattern: str, text: str, form: str) -> tuple[str, ...]:
    """The groups of a pattern that the whole of a text must match."""
    found = re.fullmatch(pattern, text.strip())
    if found is None:
        raise ValueError(f"{text!r} is not of the form {form}")
    return found.groups()


def parse_recipe(text: str) -> Recipe:
    """name:top_k:top_p"""
    name, top_k, top_p = _fields(r"([^:]+):\s*(\d+)\s*:\s*([\d.eE+-]+)", text, "name:top_k:top_p")
    return Recipe(name, int(top_k), float(top_p))


def parse_strata(text: str) -> list[Stratum]:
    """min:max:count, separated by commas"""
    parts = [p for p in re.split(r"\s*,\s*", text.strip()) if p] or [""]
    return [Stratum(*map(int, _fields(r"(\d+)\s*:\s*(\d+)\s*:\s*(\d+)", p, "min:max:count"))) for p in parts]


def parse_names(text: str) -> list[str]:
    """Names, as of models, separated by commas; ValueError if there are none."""
    names = re.findall(r"[^,\s](?:[^,]*[^,\s])?", text)
    if not names:
        raise ValueError(f"no names in {text!r}")
    return names
