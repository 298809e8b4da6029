"""User-defined operators: named ``DataFrame -> DataFrame`` functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

_OPERATORS: dict[str, Callable[..., DataFrame]] = {}


def register_operator(name: str, fn: Callable[..., DataFrame]) -> None:
    _OPERATORS[name] = fn


def registered() -> list[str]:
    return sorted(_OPERATORS)


def apply_operator(name: str, df: DataFrame, **params) -> DataFrame:
    """Run a registered operator on a (batch or streaming) DataFrame."""
    if name not in _OPERATORS:
        raise KeyError(f"no operator {name!r}; registered: {registered()}")
    return _OPERATORS[name](df, **params)
