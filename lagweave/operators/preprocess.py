"""Enrichment of transactions: zero fill, dimension joins, layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.tables import require_columns


def zero_of(kind: T.DataType) -> Column:
    """The zero of a type: '0', false, the epoch, or 0."""
    if isinstance(kind, (T.StringType, T.CharType, T.VarcharType)):
        return F.lit("0")
    if isinstance(kind, T.BooleanType):
        return F.lit(False)
    if isinstance(kind, T.DateType):
        return F.lit("1970-01-01").cast("date")
    if isinstance(kind, T.TimestampNTZType):
        return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    if isinstance(kind, T.TimestampType):
        return F.timestamp_seconds(F.lit(0))
    return F.lit(0).cast(kind)


def zero_fill(df: DataFrame) -> DataFrame:
    """Nulls of every column become the zero of its type."""
    return df.select(*(F.coalesce(F.col(f"`{f.name}`"), zero_of(f.dataType)).alias(f.name) for f in df.schema))


def enrich(tx: DataFrame, cards: DataFrame | None = None, merchants: DataFrame | None = None) -> DataFrame:
    """Add card_brand from ``cards`` and document_type (and a missing merchant category) from
    ``merchants``; columns of an earlier enrichment are replaced; nulls become zeros.

    Dimensions are joined by what their statistics allow: broadcast below the session's
    threshold, else by a shuffled join whose large keys adaptive execution splits."""
    require_columns(tx, ("merchant_id", "created_at"), "transactions")
    out = tx
    if cards is not None:
        require_columns(tx, ("card_token_id",), "transactions")
        require_columns(cards, ("id", "card_brand"), "card tokens")
        side = cards.select(F.col("id").alias("__card"), "card_brand")
        out = out.drop("card_brand").join(side, out["card_token_id"] == side["__card"], "left").drop("__card")
    if merchants is not None:
        require_columns(merchants, ("id", "document_type"), "merchants")
        coded = "merchant_category_code" in merchants.columns
        side = merchants.select(F.col("id").alias("__merchant"), "document_type", *([F.col("merchant_category_code").alias("__code")] if coded else []))
        out = out.drop("document_type").join(side, out["merchant_id"] == side["__merchant"], "left").drop("__merchant")
        if coded:
            own = [F.col("merchant_category_code")] if "merchant_category_code" in tx.columns else []
            out = out.withColumn("merchant_category_code", F.coalesce(*own, F.col("__code"), F.lit("0"))).drop("__code")
    return zero_fill(out)


def transaction_layout(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Ordered by merchant and time within and across files, nulls last; no operator needs it."""
    keys = (F.asc_nulls_last("merchant_id"), F.asc_nulls_last("created_at"))
    ranged = df.repartitionByRange(partitions, *keys) if partitions else df.repartitionByRange(*keys)
    return ranged.sortWithinPartitions(*keys)


def dataset_layout(df: DataFrame) -> DataFrame:
    require_columns(df, ("event_timestamp",), "dataset")
    return df.orderBy("event_timestamp")
