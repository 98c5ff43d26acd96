"""Running sums over a whole table without a window over the whole table.

Values are cut into ranges at approximate quantiles (a bounded list of numbers); windows run
inside the ranges and the totals of the ranges before are added."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGES = 256
ROWS_A_RANGE = 100_000


def below(value: Column, cuts: list) -> Column:
    """How many of the ascending ``cuts`` are below ``value``, by a tree of comparisons."""
    def tree(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(value <= F.lit(cuts[middle]), tree(low, middle)).otherwise(tree(middle + 1, high))
    return tree(0, len(cuts))


def _ranged(df: DataFrame, order: str, ranges: int, rows_a_range: int) -> DataFrame:
    """Add ``__range``; ranges are in the order of their values."""
    n, quantiles = df.agg(F.count("*"), F.percentile_approx(order, [i / ranges for i in range(1, ranges)], 10_000)).first()
    wanted = min(ranges, 1 + n // rows_a_range)
    cuts = sorted({quantiles[i * ranges // wanted - 1] for i in range(1, wanted)}) if quantiles else []
    return df.withColumn("__range", below(F.col(order), cuts))


def running_sums(df: DataFrame, order: str, columns: list[str], ranges: int = RANGES, rows_a_range: int = ROWS_A_RANGE) -> DataFrame:
    """Add ``<c>_upto`` for each of ``columns``: the sum over rows up to this one by ``order``,
    whose values must be distinct and not null.  There is a range per ``rows_a_range`` rows, up
    to ``ranges``; any number of ranges gives the same sums."""
    parted = _ranged(df, order, ranges, rows_a_range)
    totals = parted.groupBy("__range").agg(*(F.sum(c).alias(f"__{c}") for c in columns))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("__range", *(F.coalesce(F.sum(f"__{c}").over(before), F.lit(0)).alias(f"__{c}") for c in columns))
    inside = Window.partitionBy("__range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    # at most RANGES rows
    joined = parted.join(F.broadcast(offsets), "__range")
    return joined.select(*df.columns, *((F.sum(c).over(inside) + F.col(f"__{c}")).alias(f"{c}_upto") for c in columns))


def running_max(df: DataFrame, order: str, column: str, out: str, ranges: int = RANGES, rows_a_range: int = ROWS_A_RANGE) -> DataFrame:
    """Add ``out``: the largest ``column`` of the rows before this one by ``order``, whose values
    must be distinct and not null; null in the first row."""
    parted = _ranged(df, order, ranges, rows_a_range)
    totals = parted.groupBy("__range").agg(F.max(column).alias("__top"))
    offsets = totals.select("__range", F.max("__top").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)).alias("__top"))
    inside = Window.partitionBy("__range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    # at most RANGES rows
    joined = parted.join(F.broadcast(offsets), "__range")
    return joined.select(*df.columns, F.greatest(F.max(column).over(inside), F.col("__top")).alias(out))
