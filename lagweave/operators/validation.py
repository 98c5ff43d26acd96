"""Checks of prepared tables as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import require_columns


def null_report(df: DataFrame) -> DataFrame:
    """(column, rows, null_count, null_percent) of every column, from one aggregation."""
    counts = [F.struct(F.lit(c).alias("column"), F.count("*").alias("rows"), (F.count("*") - F.count(F.col(f"`{c}`"))).alias("null_count")) for c in df.columns]
    listed = df.agg(F.array(*counts).alias("a")).select(F.explode("a").alias("c")).select("c.*")
    return listed.withColumn("null_percent", F.when(F.col("rows") > 0, 100.0 * F.col("null_count") / F.col("rows")).otherwise(0.0))


def compare_nulls(before: DataFrame, after: DataFrame) -> DataFrame:
    """Null counts side by side; a column that one table lacks has nulls there."""
    side = lambda df, name: null_report(df).select("column", *(F.col(c).alias(f"{name}_{c}") for c in ("rows", "null_count", "null_percent")))
    return side(before, "original").join(side(after, "transformed"), "column", "full")


def _code_counts(tx: DataFrame) -> DataFrame:
    return tx.filter("merchant_id is not null").groupBy("merchant_id", "merchant_category_code").agg(F.count("*").alias("transaction_count"))


def _mismatches(tx: DataFrame, merchants: DataFrame) -> DataFrame:
    require_columns(tx, ("merchant_id", "merchant_category_code"), "transactions")
    require_columns(merchants, ("id", "merchant_category_code"), "merchants")
    side = merchants.select(F.col("id").alias("merchant_id"), F.col("merchant_category_code").alias("merchant_code"))
    return _code_counts(tx).join(side, "merchant_id").filter(~F.col("merchant_category_code").eqNullSafe(F.col("merchant_code")))


def code_mismatches(tx: DataFrame, merchants: DataFrame) -> DataFrame:
    return _mismatches(tx, merchants).select(
        "merchant_id", F.col("merchant_category_code").alias("transaction_merchant_category_code"),
        F.col("merchant_code").alias("merchant_merchant_category_code"), "transaction_count")


def code_mismatch_summary(tx: DataFrame, merchants: DataFrame) -> DataFrame:
    absent = F.col("merchant_category_code").isNull()
    codes = F.array_sort(F.collect_list(F.struct((~absent).alias("known"), F.coalesce("merchant_category_code", F.lit("NULL")).alias("code"))))
    return _mismatches(tx, merchants).groupBy("merchant_id", F.col("merchant_code").alias("merchant_category_code")).agg(
        F.array_join(F.transform(codes, lambda c: c["code"]), ", ").alias("transaction_codes"),
        F.sum("transaction_count").alias("mismatch_transaction_count"),
        F.sum(F.when(absent, F.col("transaction_count")).otherwise(0)).alias("null_transaction_count"))


def multiple_codes(merchants: DataFrame) -> DataFrame:
    codes = F.collect_set("merchant_category_code")
    return merchants.groupBy(F.col("id").alias("merchant_id")).agg(
        F.count_distinct("merchant_category_code").alias("merchant_code_count"), F.array_join(F.array_sort(codes), ", ").alias("merchant_codes")).filter("merchant_code_count > 1")


def first_sort_violation(df: DataFrame, position: str, merchant="merchant_id", created="created_at") -> DataFrame:
    """The first row, by position, that sorts before its predecessor (merchant, then time, nulls
    last).  Each row is joined with a copy of its predecessor by position,
    so no window holds the table."""
    rows = df.select(F.col(position).cast("long").alias("position"), F.col(merchant).alias("merchant"), F.col(created).alias("created"))
    # a copy of each row is sent one position on, to be met by its successor
    last = rows.select((F.col("position") + 1).alias("position"), F.struct("merchant", "created").alias("before"))
    pairs = rows.join(last, "position")
    m, t, pm, pt = F.col("merchant"), F.col("created"), F.col("before.merchant"), F.col("before.created")
    lower = lambda a, b: (a < b) | (a.isNotNull() & b.isNull())
    wrong = F.coalesce(lower(m, pm), F.lit(False)) | (m.eqNullSafe(pm) & F.coalesce(lower(t, pt), F.lit(False)))
    return pairs.filter(wrong).orderBy("position").limit(1).select(
        "position", pm.alias("previous_merchant"), m.alias("merchant"), pt.alias("previous_created"), t.alias("created"))


def stored_positions(df: DataFrame) -> DataFrame:
    """Number the rows of a stored table from 1 in stored order.

    Rows are counted per partition, and each has its number there plus the rows of the
    partitions before; so no window holds the table.  ``df`` is read twice and must come
    straight from files, whose partitions are the same each time."""
    here = df.withColumn("__part", F.spark_partition_id()).withColumn("__no", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    # one row a partition
    offsets = here.groupBy("__part").agg(F.count("*").alias("__n")).select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    return here.join(F.broadcast(offsets), "__part").withColumn("position", F.col("__before") + F.col("__no") + 1).drop("__part", "__no", "__before")
