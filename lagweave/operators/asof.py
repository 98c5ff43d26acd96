"""Point-in-time aggregates of transactions as of each event.

Transactions and events are put into one frame and every aggregate is a window frame over
it, so one exchange, by merchant, serves all windows, and no event is joined with its
history.  Right edges are strict (t < event time).  Sums and counts over a bounded window are
differences of two growing frames, which cost a constant per row.  Amounts keep their type:
sums of decimals (up to 18 digits) and whole numbers are exact; other numbers are added as
doubles, in the order of a merchant's history.  Maxima use the bounded frame.  A merchant's
rows meet in one task, as they must for the windows; sort and buffers of a window spill.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.windows import ALIASES, DAY, KINDS, Primitive
from .slices import HOT_ROWS, SLICE_ROWS, quoted, sliced


def _amount_type(kind: T.DataType) -> str:
    if isinstance(kind, T.DecimalType) and kind.precision <= 18:
        return kind.simpleString()
    return "decimal(10,0)" if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType)) else "double"


def _family_column(tx: DataFrame, family: str) -> Column:
    """A family's codes, under its name or that with ``_code``."""
    for name in (family, f"{family}_code"):
        if name in tx.columns:
            return F.col(quoted(name)).alias(family)
    raise ValueError(f"no category column for family {family!r}")


def union_frame(tx: DataFrame, events: DataFrame, families: Iterable[str] = (), keep: Iterable[str] = ()) -> DataFrame:
    """``tx``: m, t, id, amount and family columns; ``events``: m, t, id and the ``keep`` columns.
    Without a column t rows come in the order of their ids.  Event rows carry no amount and no
    category; ``kept`` has the ``keep`` columns."""
    tx, events = (df if "t" in df.columns else df.withColumn("t", F.col("id")) for df in (tx, events))
    families, money = list(families), _amount_type(tx.schema["amount"].dataType)
    right = events.select("m", "t", "id", F.lit(0).alias("is_tx"), F.lit(None).cast(money).alias("amount"), F.struct(F.lit(0).alias("_"), *keep).alias("kept"))
    left = tx.select("m", "t", "id", F.lit(1).alias("is_tx"), F.coalesce(F.col("amount").cast(money), F.lit(0).cast(money)).alias("amount"),
                     F.lit(None).cast(right.schema["kept"].dataType).alias("kept"), *(_family_column(tx, f) for f in families))
    right = right.select("*", *(F.lit(None).cast(left.schema[f].dataType).alias(f) for f in families))
    return left.unionByName(right)


def _placed(frame: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Add ``day``, and ``pos``: a transaction's rank, or the number before an event."""
    order = Window.partitionBy(*by).orderBy("t", "is_tx", "id").rowsBetween(Window.unboundedPreceding, 0)
    return frame.withColumn("day", F.floor(F.col("t") / F.lit(DAY)).cast("long")).withColumn("pos", F.sum("is_tx").over(order))


def _category(p: Primitive) -> Column:
    if p.category_family is None:  # without a family every transaction is of category 0
        return F.lit(not p.category_code)
    return F.col(p.category_family) == F.lit(p.category_code if p.category_code is not None else 0)


def _measure(p: Primitive, what: str) -> Column:
    if what == "n":
        return F.col("is_tx")
    if what == "cat":
        return F.when(_category(p) & (F.col("is_tx") == 1), 1).otherwise(0)
    if what == "cat_sum":
        return F.when(_category(p), F.col("amount"))
    return {"sum": F.col("amount"), "squares": F.col("amount") * F.col("amount"), "max": F.col("amount")}[what]


def _moment(p: Primitive, what: str) -> str:
    """The name under which slices carry a moment."""
    return "_".join([what, *([str(p.category_family), str(p.category_code)] if what.startswith("cat") else [])])


def _over(p: Primitive, what: str, by: tuple[str, ...] = ("m",)) -> Column:
    """One moment over the window of ``p``; counts and sums are 0 where it is empty.  In slices
    the whole history also has what they carry."""
    x, first = _measure(p, what), Window.unboundedPreceding
    by_t, by_pos = Window.partitionBy(*by).orderBy("t"), Window.partitionBy(*by).orderBy("pos")
    by_day, in_day = Window.partitionBy(*by).orderBy("day"), Window.partitionBy(*by, "day").orderBy("t")
    carried = F.col(f"__carried.{quoted(_moment(p, what))}") if "__slice" in by and p.window == -1 else None
    if what == "max":
        if p.window_type == "time":
            top = F.max(x).over(by_t.rangeBetween(first if p.window == -1 else -p.window, -1))
            return top if carried is None else F.greatest(top, carried)
        if p.window_type == "row":
            return F.max(x).over(by_pos.rangeBetween(-(p.window - 1), 0))
        return F.greatest(F.max(x).over(by_day.rangeBetween(-(p.window - 1), -1)), F.max(x).over(in_day.rangeBetween(first, -1)))
    total = lambda w: F.coalesce(F.sum(x).over(w), F.lit(0))
    if p.window_type == "time":
        upto = total(by_t.rangeBetween(first, -1))
        if carried is not None:
            return upto + F.coalesce(carried, F.lit(0))
        return upto if p.window == -1 else upto - total(by_t.rangeBetween(first, -p.window - 1))
    if p.window_type == "row":
        return total(by_pos.rangeBetween(first, 0)) - total(by_pos.rangeBetween(first, -p.window))
    return total(by_day.rangeBetween(first, -1)) - total(by_day.rangeBetween(first, -p.window)) + total(in_day.rangeBetween(first, -1))


# Moments that each kind is made of.
MOMENTS = {"mean": ("n", "sum"), "max": ("max",), "std": ("n", "sum", "squares"), "total_amount": ("sum",), "count_total": ("n",), "count_category": ("cat",),
           "avg_daily_count": ("n",), "avg_daily_count_category": ("cat",), "avg_daily_amount": ("sum",), "avg_daily_total_amount": ("sum",),
           "avg_daily_amount_category": ("cat_sum",)}


def _kind(p: Primitive) -> str:
    kind = ALIASES.get(p.kind, p.kind)
    if kind not in KINDS:
        raise ValueError(f"unknown kind {p.kind!r}")
    return kind


def value_column(p: Primitive, by: tuple[str, ...] = ("m",)) -> Column:
    """The feature as a double over a union frame; null where the window is empty and the kind
    has no value then."""
    kind = _kind(p)
    real = lambda what: _over(p, what, by).cast("double")
    if kind == "mean":
        return F.when(_over(p, "n", by) > 0, real("sum") / real("n"))
    if kind == "max":
        return real("max")
    if kind == "std":
        mean = real("sum") / real("n")
        return F.when(_over(p, "n", by) > 0, F.sqrt(F.greatest(real("squares") / real("n") - mean * mean, F.lit(0.0))))
    (what,) = MOMENTS[kind]
    return real(what) / F.lit(float(p.window)) if kind.startswith("avg_daily") else real(what)


def event_features(tx: DataFrame, events: DataFrame, primitives: Iterable[Primitive], keep: Iterable[str] = (), hot_rows: int = HOT_ROWS, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """One row per event: id, the ``keep`` columns of its row, and a column per primitive, named by it.
    Equal primitives are computed once.  A merchant of more than ``hot_rows`` rows is cut into
    slices of about ``slice_rows``."""
    wanted = {p.name: p for p in primitives}
    families = sorted({p.category_family for p in wanted.values() if p.category_family})
    keep = list(keep)
    frame, by = union_frame(tx, events, families, keep), ("m",)
    whole = {_moment(p, what): (F.max if what == "max" else F.sum)(_measure(p, what)) for p in wanted.values() if p.window == -1 for what in MOMENTS[_kind(p)]}
    cut = sliced(frame, list(wanted.values()), whole, hot_rows, slice_rows)
    if cut is not None:
        frame, by = cut, ("m", "__slice")
    # kept columns travel with their event, so nothing is joined back
    out = _placed(frame, by).select("id", "is_tx", "kept", *(value_column(p, by).alias(name) for name, p in wanted.items())).filter("is_tx = 0")
    return out.select("id", *(F.col(f"kept.{quoted(c)}").alias(c) for c in keep), *(F.col(quoted(name)) for name in wanted))


def transaction_features(tx: DataFrame, primitives: Iterable[Primitive]) -> DataFrame:
    """The same aggregates as of each transaction; it and its equals in time are left out."""
    return event_features(tx, tx.select("m", "t", "id"), primitives)
