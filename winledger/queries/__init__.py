"""The query catalogue: one entry per operator, with an independent SQL check where SQL can say it."""

from __future__ import annotations

import importlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Query:
    name: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


CATALOGUE: dict[str, Query] = {}

_AREAS = (
    "tasks", "money", "statistics", "packs", "migration", "checks", "guarding", "market", "jury",
    "conversations", "ingest", "streams",

)


def query(name: str, sql: str | None = None):
    """Register a query under ``name`` with its oracle SQL."""
    def add(run):
        if name in CATALOGUE:
            raise ValueError(f"duplicate query {name}")
        CATALOGUE[name] = Query(name, run, sql)
        return run
    return add


def load() -> dict[str, Query]:
    for area in _AREAS:
        importlib.import_module(f"winledger.queries.{area}")
    return CATALOGUE


def num(col, name: str, digits: int = 6) -> Column:
    """A number as a rounded double under a fixed name."""
    c = F.col(col) if isinstance(col, str) else col
    return F.round(c.cast("double"), digits).alias(name)


def cnt(col, name: str) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return c.cast("long").alias(name)
