"""Label encoding: codes from the transactions of training merchants."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import require_columns

# The columns that are encoded.
ENCODED = ("status", "capture_method", "payment_method", "card_brand", "document_type")


def mapping_table(tx: DataFrame, dataset: DataFrame, columns=ENCODED) -> DataFrame:
    """(family, category, code): dense codes, from 0, of the sorted categories that occur with a
    merchant of the training split."""
    require_columns(tx, ("merchant_id", *columns), "transactions")
    require_columns(dataset, ("merchant_id", "split"), "dataset")
    train = dataset.filter(F.col("split") == "train").select("merchant_id")
    seen = tx.join(train, "merchant_id", "left_semi")
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("family"), F.col(c).cast("string").alias("category")) for c in columns)))
    distinct = seen.select(pairs.alias("p")).select("p.*").filter("category is not null").distinct()
    return distinct.withColumn("code", F.row_number().over(Window.partitionBy("family").orderBy("category")) - 1)


def fit_mapping(tx: DataFrame, dataset: DataFrame, columns=ENCODED) -> dict[str, dict[str, int]]:
    """The table as {family: {category: code}}; categories are few by nature of the columns."""
    mapping: dict[str, dict[str, int]] = {c: {} for c in columns}
    for row in mapping_table(tx, dataset, columns).orderBy("family", "code").collect():
        mapping[row.family][row.category] = row.code
    return mapping


def encode(tx: DataFrame, mapping: dict[str, dict[str, int]]) -> DataFrame:
    """Codes in place of categories; unknown and null become the number of known ones."""
    require_columns(tx, mapping, "transactions")

    def code(name):
        known = mapping[name]
        if not known:
            return F.lit(0).cast("int")
        table = F.create_map(*(F.lit(x) for item in known.items() for x in item))
        return F.coalesce(F.try_element_at(table, F.col(name).cast("string")), F.lit(len(known))).cast("int")
    return tx.select(*(code(c).alias(c) if c in mapping else F.col(f"`{c}`") for c in tx.columns))


def code_lists(mapping: dict[str, dict[str, int]], families) -> list[list[int]]:
    missing = [f for f in families if f not in mapping]
    if missing:
        raise ValueError(f"the mapping lacks {', '.join(missing)}")
    return [sorted(set(mapping[f].values())) for f in families]


def unknown_code(mapping: dict[str, dict[str, int]], family: str) -> int:
    return len(mapping[family])
