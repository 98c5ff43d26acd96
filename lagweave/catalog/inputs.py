"""How the test tables stand in for transactions, events and dimensions.

E: ``events``; purchases are the labelled events, the rest are transactions of a user.
O: ``orders``; dates have no time, so timestamps are often equal.
L: ``lineitem`` with ``part`` as card tokens and ``supplier`` as merchants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import micros

LABEL_ABOVE = 34.59
SPLIT_DAY = "2024-01-22"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _events(spark, sf_dir):
    df = table(spark, sf_dir, "events")
    return df.withColumn("t", micros("ts", df.schema["ts"].dataType))


def event_transactions(spark, sf_dir) -> DataFrame:
    return _events(spark, sf_dir).filter("event_type <> 'purchase'").select(
        F.col("event_id").alias("id"), F.col("user_id").alias("m"), "t", F.col("value").cast("decimal(18,2)").alias("amount"), F.col("event_type").alias("status"))


def event_spine(spark, sf_dir) -> DataFrame:
    return _events(spark, sf_dir).filter("event_type = 'purchase'").select(
        F.col("event_id").alias("id"), F.col("user_id").alias("m"), "t", (F.col("value") > LABEL_ABOVE).cast("int").alias("label"),
        F.when(F.col("t") < F.lit(SPLIT_MICROS), "train").otherwise("test").alias("split"))


SPLIT_MICROS = 1705881600000000  # SPLIT_DAY in microseconds

# The same in SQL.
TX = "tx AS (SELECT event_id AS id, user_id AS m, epoch_us(ts) AS t, CAST(value AS DECIMAL(18,2)) AS v, event_type AS status FROM events WHERE event_type <> 'purchase')"
EV = f"""ev AS (SELECT event_id AS id, user_id AS m, epoch_us(ts) AS t, CAST(value > {LABEL_ABOVE} AS INTEGER) AS label,
  CASE WHEN ts < TIMESTAMP '{SPLIT_DAY}' THEN 'train' ELSE 'test' END AS split FROM events WHERE event_type = 'purchase')"""


def order_transactions(spark, sf_dir) -> DataFrame:
    df = table(spark, sf_dir, "orders")
    return df.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("m"), micros("o_orderdate", df.schema["o_orderdate"].dataType).alias("t"),
                     F.col("o_totalprice").cast("decimal(18,2)").alias("amount"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("payment_method"))


ORD = "o AS (SELECT o_orderkey AS id, o_custkey AS m, epoch_us(o_orderdate) AS t, CAST(o_totalprice AS DECIMAL(18,2)) AS v, o_orderstatus AS status FROM orders)"
