"""Registered queries: a Spark callable and, where one exists, the checking SQL."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers the decorated (spark, sf_dir) -> DataFrame under ``name``."""
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def load_all() -> None:
    from ionweave.plans import (q_acquisition, q_census, q_evaluation, q_files, q_identification, q_placement, q_quality, q_scalar, q_shifts, q_species, q_tagging)  # noqa: F401
