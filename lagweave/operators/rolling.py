"""Trailing windows over a merchant's rows, the row itself left out.

Unlike as-of windows, an earlier row with the same timestamp is inside a time window.  Time
windows add two disjoint frames: strictly earlier times, and earlier rows of the same time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.windows import Trailing

AGGREGATES = ("count", "sum", "mean", "max")
MODES = ("rows", "time", "total")


def aggregate(df: DataFrame, partition: str, order: str, tiebreak: str, value: str | None, aggregation: str, window: Trailing) -> Column:
    """``sliding_window`` over a window object."""
    if not isinstance(window, Trailing):
        raise TypeError(f"not a trailing window: {type(window).__name__}")
    return sliding_window(df, partition, order, tiebreak, value, aggregation, window.mode, window.span)


def sliding_window(df: DataFrame, partition: str, order: str, tiebreak: str, value: str | None, aggregation: str = "count", mode: str = "rows", span: int = 0) -> Column:
    """A column of ``df``; ``order`` is a whole number, empty windows give null except for counts."""
    if aggregation not in AGGREGATES:
        raise ValueError(f"unknown aggregation {aggregation!r}")
    if mode not in MODES:
        raise ValueError(f"unknown window mode {mode!r}")
    if mode != "total" and span <= 0:
        raise ValueError("the span must be above 0")
    if aggregation != "count" and value is None:
        raise ValueError("values are needed")
    for name in (partition, order, tiebreak, *([value] if value else [])):
        if name not in df.columns:
            raise ValueError(f"no column {name}")
    rows = Window.partitionBy(partition).orderBy(order, tiebreak)
    if mode == "rows":
        frames = [rows.rowsBetween(-span, -1)]
    elif mode == "total":
        frames = [rows.rowsBetween(Window.unboundedPreceding, -1)]
    else:
        frames = [Window.partitionBy(partition).orderBy(order).rangeBetween(-span, -1),
                  Window.partitionBy(partition, order).orderBy(tiebreak).rowsBetween(Window.unboundedPreceding, -1)]
    counts = [F.count(F.lit(1)).over(f) for f in frames]
    n = counts[0] if len(counts) == 1 else counts[0] + counts[1]
    if aggregation == "count":
        return n.cast("double")
    if aggregation == "max":
        tops = [F.max(value).over(f) for f in frames]
        return (tops[0] if len(tops) == 1 else F.greatest(*tops)).cast("double")
    sums = [F.coalesce(F.sum(value).over(f), F.lit(0)) for f in frames]
    total = (sums[0] if len(sums) == 1 else sums[0] + sums[1]).cast("double")
    return F.when(n > 0, total if aggregation == "sum" else total / n)
