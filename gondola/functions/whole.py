"""Figures over all rows of a frame, for use beside the rows themselves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from gondola.functions.measures import over


def one_row(df: DataFrame, *columns: str) -> Column:
    """A one-row frame as a scalar struct, for use beside the rows of another frame."""
    return df.select(F.struct(*(columns or df.columns))).scalar()


def over_limited(aggregate: Column) -> Column:
    """An aggregate over all rows of a frame that a LIMIT has already cut to a few hundred rows.

    Only for such frames: the window has no partition and runs in one task.
    """
    return aggregate.over(Window.partitionBy())


def beside(df: DataFrame, **aggregates: Column) -> Column:
    """Aggregates over all rows of ``df``, as a scalar struct to use next to those rows.

    A scalar subquery: partial results per task, one row back.  An unpartitioned window would pull
    every row into one task instead.  The subquery also asks for the maximum of every column, so
    it needs exactly what the frame itself needs; Spark then runs their common part once and
    reuses its shuffle, where a narrower subquery would scan the tables a second time.
    """
    rest = [F.max(c).alias(f"_{c}") for c in df.columns]
    return one_row(df.agg(*[a.alias(name) for name, a in aggregates.items()], *rest))


def share_of_total(df: DataFrame, column: str) -> Column:
    """A value over its total across all rows."""
    return over(F.col(column), beside(df, total=F.sum(column)).getField("total"))
