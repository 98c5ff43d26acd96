"""Merchants with very many rows, cut into slices of time whose windows run side by side.

A hot merchant's history is laid on a grid of cells, ``CELLS`` to a slice.  A slice is at least
as long as the longest bounded window, and a slice's frame also holds the transactions before
it that its windows reach, so a transaction is in two slices at most for windows of time or
days; windows of rows add the cells that hold the rows they reach.  What lies before the frame
comes as one carried value for each moment of the whole history.  Slices are of equal length in time: rows at
one time stay together, and a burst within a cell is not cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.windows import DAY, Primitive

HOT_ROWS = 2_000_000
SLICE_ROWS = 1_000_000
SLICES = 256
CELLS = 16
FEW = 1000  # hot merchants whose slices are broadcast: 256 rows each at most


def hot_merchants(frame: DataFrame, hot_rows: int) -> DataFrame:
    """(__hm, n, __low, high) of merchants with more than ``hot_rows`` rows of ``frame``."""
    times = F.floor("t").cast("long")
    counted = frame.groupBy(F.col("m").alias("__hm")).agg(F.count("*").alias("n"), F.min(times).alias("__low"), F.max(times).alias("high"))
    return counted.filter(F.col("n") > hot_rows)


def _cell() -> Column:
    """The cell of a row beside its merchant's grid; rows without a time come first, as they sort."""
    return F.coalesce(F.expr("(cast(floor(t) as long) - __low) div __width"), F.lit(0).cast("long"))


def quoted(name: str) -> str:
    """A name that may hold any character, as a column's."""
    return "`" + name.replace("`", "``") + "`"


def _grid(hot: DataFrame, reach: int, slice_rows: int) -> DataFrame:
    """(__hm, __low, __width, __cells): the width of a cell and the number of cells."""
    span = F.coalesce(F.col("high") - F.col("__low") + 1, F.lit(1).cast("long"))
    wanted = F.least(F.lit(SLICES).cast("long"), F.ceil(F.col("n") / slice_rows).cast("long"), F.floor(span / F.lit(max(reach, 1))).cast("long"))
    sliced = hot.select("__hm", "__low", span.alias("span"), (F.greatest(wanted, F.lit(1).cast("long")) * CELLS).alias("__cells"))
    return sliced.select("__hm", "__low", F.ceil(F.col("span") / F.col("__cells")).cast("long").alias("__width"), "__cells")


def _reached(primitives: list[Primitive]) -> tuple[int, int, int]:
    """The longest bounded windows in time, days and rows; 0 where there are none."""
    longest = {"time": 0, "days": 0, "row": 0}
    for p in primitives:
        longest[p.window_type] = max(longest[p.window_type], p.window)
    return longest["time"], longest["days"], longest["row"]


def sliced(frame: DataFrame, primitives: list[Primitive], moments: dict[str, Column], hot_rows: int = HOT_ROWS, slice_rows: int = SLICE_ROWS) -> DataFrame | None:
    """``frame`` with ``__slice``, null for merchants that are not hot, and ``__carried``, a struct of
    the ``moments`` of all transactions before the slice's frame.  Transactions that a later
    slice reaches are repeated there; events are not.  None if no merchant is hot."""
    hot = hot_merchants(frame, hot_rows)
    known = hot.limit(FEW + 1).count()
    if not known:
        return None
    micros, days, rows = _reached(primitives)
    grid = _grid(hot, max(micros, days * DAY), slice_rows)
    small = (lambda df: F.broadcast(df)) if known <= FEW else (lambda df: df)  # FEW merchants at most

    inside = frame.filter("is_tx = 1").join(small(grid), F.col("m").eqNullSafe(F.col("__hm")))
    made = inside.groupBy(F.col("__hm").alias("__cm"), _cell().alias("__c")).agg(F.count("*").alias("here"), *(x.alias(name) for name, x in moments.items()))
    every = grid.select("__hm", "__low", "__width", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__cells") - 1)).alias("__cell"))
    dense = every.join(made, F.col("__hm").eqNullSafe(F.col("__cm")) & (F.col("__cell") == F.col("__c")), "left")
    before = Window.partitionBy("__hm").orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    total = lambda name: (F.max if name.startswith("max") else F.sum)(quoted(name)).over(before).alias(name)
    running = dense.select("__hm", "__low", "__width", "__cell", F.coalesce(F.sum("here").over(before), F.lit(0)).cast("long").alias("past"), *(total(name) for name in moments))

    offset, zero = F.col("__cell") * F.col("__width"), F.lit(0).cast("long")
    first_day = F.floor((F.col("__low") + offset) / F.lit(DAY)).cast("long") - (days - 1)
    holds = Window.partitionBy("__hm").orderBy("past").rangeBetween(Window.unboundedPreceding, -rows)
    placed = running.select("*", (F.coalesce(F.max("__cell").over(holds), zero) if rows else F.col("__cell")).alias("by_rows"),
                            F.greatest(offset - micros, zero).alias("by_time"),
                            (F.least(offset, F.greatest(first_day * DAY - F.col("__low"), zero)) if days else offset).alias("by_days"))
    starts = placed.filter(F.col("__cell") % CELLS == 0).select(
        F.col("__hm").alias("__sm"), (F.col("__cell") / CELLS).cast("long").alias("slice"), F.least("by_rows", F.expr("by_time div __width"), F.expr("by_days div __width")).alias("first"))
    at = starts.join(running, F.col("__sm").eqNullSafe(F.col("__hm")) & (F.col("first") == F.col("__cell")))
    slices = at.groupBy("__sm").agg(F.sort_array(F.collect_list(F.struct("slice", "first", *(quoted(name) for name in moments)))).alias("__slices"))  # SLICES at most
    plan = grid.join(slices, F.col("__hm").eqNullSafe(F.col("__sm"))).select("__hm", "__low", "__width", "__slices")

    laid = frame.join(small(plan), F.col("m").eqNullSafe(F.col("__hm")), "left").withColumn("__cell", _cell())
    own = F.expr(f"__cell div {CELLS}")
    mine = F.filter("__slices", lambda s: (s["slice"] == own) | ((F.col("is_tx") == 1) & (s["first"] <= F.col("__cell")) & (F.col("__cell") < s["slice"] * CELLS)))
    none = F.array(F.lit(None).cast(plan.schema["__slices"].dataType.elementType))
    spread = laid.select(*frame.columns, F.explode(F.when(F.col("__slices").isNull(), none).otherwise(mine)).alias("__carried"))
    return spread.withColumn("__slice", F.col("__carried.slice"))
