"""Time anchors shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerwatch.functions.columns import interval_before


def anchor(df: DataFrame, as_of=None, ts: str = "ts") -> Column:
    """``as_of`` as a Column; the newest timestamp of ``df`` (a scalar subquery) where it is not given."""
    if as_of is None:
        return df.select(F.max(ts)).scalar()
    return as_of if isinstance(as_of, Column) else F.lit(as_of).cast("timestamp")


def since(df: DataFrame, seconds: float | None, as_of=None, ts: str = "ts") -> DataFrame:
    """Rows newer than ``as_of - seconds``; all rows where ``seconds`` is None."""
    if seconds is None:
        return df
    return df.filter(F.col(ts) > interval_before(anchor(df, as_of, ts), seconds))


def event_age(df: DataFrame, as_of=None, ts: str = "ts") -> Column:
    """Whole seconds between each row and the anchor."""
    return F.unix_seconds(anchor(df, as_of, ts)) - F.unix_seconds(F.col(ts))
