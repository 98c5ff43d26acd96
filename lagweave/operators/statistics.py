"""Statistics of runs: quartiles, presence counts, rank tests, and the figure tables."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .evaluation import average_ranks

# The families and operators that the presence table counts, as patterns of an
# expression's text.
PRESENCE = {
    "Amount aggregate": r"feat_(?:mean|max|total|std)_amount",
    "Count aggregate": r"feat_count_",
    "Daily aggregate": r"feat_avg_daily_",
    "Category rate": r"feat_category_rate",
    "Addition (+)": r"\+",
    "Subtraction (-)": r" - ",
    "Multiplication (*)": r"\*",
    "Safe division (/)": r" / ",
    "Signed log": r"signed_log\(",
}


def quartiles(df: DataFrame, group: str, value: str) -> DataFrame:
    p = lambda q: F.percentile(value, F.lit(q))
    return df.filter(F.col(value).isNotNull()).groupBy(group).agg(F.count("*").alias("n"), p(0.25).alias("q1"), p(0.5).alias("median"), p(0.75).alias("q3"))


def row_spread(df: DataFrame, columns: list[str], out: str = "fold_sd") -> DataFrame:
    """Population deviation across columns; null with fewer than two values."""
    values = F.filter(F.array(*columns), lambda x: x.isNotNull())
    n = F.size("__v")
    mean = F.aggregate("__v", F.lit(0.0), lambda s, x: s + x) / n
    sd = F.sqrt(F.aggregate("__v", F.lit(0.0), lambda s, x: s + (x - F.col("__m")) * (x - F.col("__m"))) / n)
    return df.withColumn("__v", values).withColumn("__m", F.when(n > 0, mean)).withColumn(out, F.when(n > 1, sd)).drop("__v", "__m")


def row_mean(columns: list[str]):
    values = F.filter(F.array(*columns), lambda x: x.isNotNull())
    return F.when(F.size(values) > 0, F.aggregate(values, F.lit(0.0), lambda s, x: s + x) / F.size(values))


def outcome_table(df: DataFrame, generation: str, status: str, statuses: list[str]) -> DataFrame:
    return df.filter(F.col(generation).isNotNull()).groupBy(generation).pivot(status, statuses).count().fillna(0, statuses)


def scores_by_generation(df: DataFrame, generation: str, folds: list[str]) -> DataFrame:
    return df.withColumn("score", row_mean(folds)).groupBy(generation).agg(F.max("score").alias("best"), F.median("score").alias("median"))


def progress(df: DataFrame, generation: str, evaluated: str) -> DataFrame:
    """Running number of evaluations; generations are few."""
    upto = Window.orderBy(generation).rowsBetween(Window.unboundedPreceding, 0)
    return df.select(generation, evaluated, F.sum(evaluated).over(upto).alias("cumulative"))


def presence_counts(df: DataFrame, text: str, patterns: dict[str, str] = PRESENCE) -> DataFrame:
    """(name, n) for regular expressions found in at least one text; one aggregation."""
    counts = [F.struct(F.lit(k).alias("name"), F.coalesce(F.sum(F.col(text).rlike(p).cast("long")), F.lit(0)).alias("n")) for k, p in patterns.items()]
    return df.agg(F.array(*counts).alias("a")).select(F.explode("a").alias("c")).select("c.*").filter("n > 0")


def diagnostics(df: DataFrame, generation: str, seconds: str, depends: str) -> DataFrame:
    parts = F.filter(F.transform(F.split(depends, ";"), lambda x: F.trim(x)), lambda x: x != "")
    totals = df.agg(F.max(generation).alias("generations"), F.sum(seconds).alias("seconds"))
    return totals.withColumn("dependencies", F.lit(df.select(F.explode(parts).alias("d")).distinct().count()).cast("long"))


def rank_biserial(df: DataFrame, group: str, first: str, second: str, value: str) -> DataFrame:
    """(u, effect) of ``first`` against ``second``: Mann-Whitney U with tied ranks averaged."""
    both = df.filter(F.col(group).isin(first, second) & F.col(value).isNotNull())
    ranked = average_ranks(both, value, "rank")
    mine = F.col(group) == first
    sums = ranked.agg(F.sum(F.when(mine, F.col("rank"))).alias("r"), F.sum(mine.cast("long")).alias("n1"), F.sum((~mine).cast("long")).alias("n2"))
    u = F.col("r") - F.col("n1") * (F.col("n1") + 1) / 2
    return sums.select(u.alias("u"), (2 * u / (F.col("n1") * F.col("n2")) - 1).alias("effect"), "n1", "n2")


def kruskal(df: DataFrame, group: str, value: str) -> DataFrame:
    """(h, groups, n) corrected for ties; h is null where all values are equal."""
    ranked = average_ranks(df.filter(F.col(value).isNotNull()), value, "rank")
    by = ranked.groupBy(group).agg(F.sum("rank").alias("r"), F.count("*").alias("n"))
    ties = ranked.groupBy(value).agg(F.count("*").alias("t")).agg(F.sum((F.col("t") * F.col("t") * F.col("t") - F.col("t")).cast("double")).alias("ties")).first()[0] or 0.0
    n = F.sum("n").cast("double")
    h = (12.0 / (n * (n + 1)) * F.sum(F.col("r") * F.col("r") / F.col("n")) - 3 * (n + 1)) / F.nullif(1 - F.lit(ties) / F.nullif(n * n * n - n, F.lit(0.0)), F.lit(0.0))
    return by.agg(h.alias("h"), F.count("*").alias("groups"), F.sum("n").alias("n"))


def normal_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def chi2_tail(x: float, df: int) -> float:
    """Upper tail by the series of the incomplete gamma function."""
    a, x = df / 2, x / 2
    if x <= 0:
        return 1.0
    term = total = 1 / a
    k = a
    while term > total * 1e-16:
        k += 1
        term *= x / k
        total += term
    return max(0.0, 1 - total * math.exp(-x + a * math.log(x) - math.lgamma(a)))


def holm(df: DataFrame, p: str, tiebreak: str) -> DataFrame:
    """Add ``adjusted``: Holm's step-down p-values.  Tests are few."""
    order = Window.orderBy(p, tiebreak)
    n = F.count("*").over(Window.partitionBy())
    raw = F.col(p) * (n - F.row_number().over(order) + 1)
    stepped = df.withColumn("__raw", raw)
    return stepped.withColumn("adjusted", F.least(F.lit(1.0), F.max("__raw").over(order.rowsBetween(Window.unboundedPreceding, 0)))).drop("__raw")
