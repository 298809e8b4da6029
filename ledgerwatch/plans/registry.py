"""Pairs every query with its SQL counterpart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from ledgerwatch.adapters import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# Common table expressions of the adapters, by name, in dependency order.
CTES: dict[str, str] = {}


def cte(name: str, sql: str) -> None:
    CTES[name] = sql


def compose(sql: str, uses: str, rounded: str, places: int) -> str:
    needed = [n for n in CTES if n in uses.split()]
    text = f"SELECT * FROM (\n{sql.strip()}\n)"
    if rounded:
        swaps = ", ".join(f"ROUND(CAST({c} AS DOUBLE) + 1e-9, {places}) AS {c}" for c in rounded.split())
        text = f"SELECT * REPLACE ({swaps}) FROM (\n{sql.strip()}\n)"
    if needed:
        text = "WITH " + ",\n".join(f"{n} AS (\n{CTES[n].strip()}\n)" for n in needed) + "\n" + text
    return text


def round_floats(df: DataFrame, places: int) -> DataFrame:
    """Floating results are compared at a fixed number of places, nudged off ties."""
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (DoubleType, FloatType))}
    return df.select(
        *[F.round(F.col(c) + F.lit(1e-9), places).alias(c) if c in floats else F.col(c) for c in df.columns]
    )


def query(key: str, sql: str | None = None, uses: str = "tx", rounded: str = "", places: int = 6):
    """Register ``fn(tables) -> DataFrame`` under ``key``; ``rounded`` names the floating columns of ``sql``."""

    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return round_floats(fn(Tables(spark, sf_dir)), places)

        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        if key in QUERIES:
            raise ValueError(f"{key} is registered twice")
        QUERIES[key] = run
        if sql is not None:
            ORACLES[key] = compose(sql, uses, rounded, places)
        return fn

    return register
