"""Queries over the retrieval operators, with the DuckDB SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_MODULES: tuple[str, ...] = ("retrieval", "evidence", "classify", "selecting", "stateful", "reading", "judging", "asking", "knowing", "weighing", "filing", "recorded", "shaped", "coding", "marking", "fetched", "bodied", "stored", "feeding", "walking")


def _each(name: str) -> dict:
    import importlib

    out: dict = {}
    for m in _MODULES:
        out |= getattr(importlib.import_module(f"sievework.plans.{m}"), name)
    return out


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _each("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _each("ORACLES")
