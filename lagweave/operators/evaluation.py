"""Chronological folds, residual stumps and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import clip_probability, logit, newton_response, newton_weight, safe_corr, sigmoid
from ..functions.windows import DAY
from .prefix import running_sums

LEAF = 150
SHRINKAGE = 0.2
LEAST_STD = 1e-8


def time_groups(events: DataFrame, t: str = "t", width: int = DAY) -> DataFrame:
    """Add ``grp``: the rank, from 0, of the distinct time.  Times are ranked inside days and
    days are counted, so there is no window over all rows."""
    bucket = F.floor(F.col(t) / F.lit(width)).cast("long")
    distinct = events.select(F.col(t).alias("t"), bucket.alias("b")).distinct()
    counts = distinct.groupBy("b").agg(F.count("*").alias("n"))
    before = counts.select("b", F.coalesce(F.sum("n").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    ranked = distinct.withColumn("r", F.row_number().over(Window.partitionBy("b").orderBy("t"))).join(before, "b")
    groups = ranked.select(F.col("t").alias("__t"), (F.col("before") + F.col("r") - 1).alias("grp"))
    return events.join(groups, events[t] == groups["__t"]).drop("__t")


def fold_bounds(groups: int, folds: int = 3) -> list[tuple[int, int]]:
    """(first, end) validation group of each expanding fold; all groups before are training."""
    if folds < 2:
        raise ValueError("at least two folds are needed")
    if groups <= folds:
        raise ValueError(f"{groups} distinct timestamps are too few for {folds} folds")
    size = groups // (folds + 1)
    return [(groups - (folds - k) * size, groups - (folds - k - 1) * size) for k in range(folds)]


def assign_folds(events: DataFrame, folds: int = 3, t: str = "t") -> DataFrame:
    """A row per event and fold it takes part in: fold, role 'train' or 'valid'."""
    grouped = time_groups(events, t)
    n = events.select(t).distinct().count()
    parts = [F.struct(F.lit(k).alias("fold"), F.when(F.col("grp") < a, "train").when(F.col("grp") < b, "valid").alias("role")) for k, (a, b) in enumerate(fold_bounds(n, folds))]
    return grouped.withColumn("__f", F.explode(F.array(*parts))).select("*", "__f.fold", "__f.role").drop("__f").filter("role is not null")


def fold_baselines(assigned: DataFrame, label: str = "label") -> DataFrame:
    """Per fold: rows, clipped training mean and its logit."""
    train = assigned.filter("role = 'train'").groupBy("fold").agg(F.count("*").alias("n_train"), clip_probability(F.avg(F.col(label).cast("double"))).alias("base"))
    return train.withColumn("intercept", logit(F.col("base")))


def split_points(byx: DataFrame, leaf: int = LEAF) -> DataFrame:
    """Candidate splits from sums per value (x, n, w, s): sums on the left and the gain, null
    where a side would have fewer than ``leaf`` rows."""
    summed = running_sums(byx, "x", ["n", "w", "s"])
    total = byx.agg(F.sum("n").alias("N"), F.sum("w").alias("W"), F.sum("s").alias("S")).first()
    full = summed.withColumn("N", F.lit(total.N or 0)).withColumn("W", F.lit(total.W or 0.0)).withColumn("S", F.lit(total.S or 0.0))
    ok = (F.col("n_upto") >= leaf) & (F.col("N") - F.col("n_upto") >= leaf)
    left, right = F.col("s_upto"), F.col("S") - F.col("s_upto")
    return full.withColumn("gain", F.when(ok, left * left / F.col("w_upto") + right * right / (F.col("W") - F.col("w_upto"))))


def best_split(rows: DataFrame, x: str, weight: str, response: str, leaf: int = LEAF) -> dict | None:
    """threshold, left and right leaf values of a stump on ``x`` (nulls as 0); None where no split
    keeps ``leaf`` rows a side.  Rows are read once; the rest works on sums per value."""
    v = F.coalesce(F.col(x), F.lit(0.0)).cast("float").cast("double")
    byx = rows.groupBy(v.alias("x")).agg(F.count("*").alias("n"), F.sum(weight).alias("w"), F.sum(F.col(weight) * F.col(response)).alias("s")).persist()
    try:
        best = split_points(byx, leaf).filter("gain is not null").orderBy(F.desc(F.round("gain", 9)), "x").limit(1).collect()
        if not best:
            return None
        b = best[0]
        after = byx.filter(F.col("x") > b.x).agg(F.min("x")).first()[0]
        return {"threshold": (b.x + after) / 2, "left": b.s_upto / b.w_upto, "right": (b.S - b.s_upto) / (b.W - b.w_upto), "gain": b.gain}
    finally:
        byx.unpersist()


def fit_stump(rows: DataFrame, x: str, weight: str, response: str, leaf: int = LEAF) -> tuple[Column, dict]:
    """Prediction column and description: a split, the weighted mean where there is none, or 0
    where ``x`` does not vary."""
    value = F.coalesce(F.col(x), F.lit(0.0))
    std = rows.agg(F.stddev_pop(value)).first()[0]
    if std is None or std < LEAST_STD:
        return F.lit(0.0), {"constant": 0.0}
    split = best_split(rows, x, weight, response, leaf)
    if split is None:
        mean = rows.agg(F.sum(F.col(weight) * F.col(response)) / F.sum(weight)).first()[0]
        return F.lit(float(mean)), {"constant": mean}
    return F.when(value.cast("float").cast("double") <= split["threshold"], split["left"]).otherwise(split["right"]), split


def brier(y: Column, p: Column) -> Column:
    return F.avg((y - p) * (y - p))


def relative_improvement(corrected: Column, baseline: Column) -> Column:
    return F.when(baseline > 1e-12, 1 - corrected / baseline).otherwise(0.0)


def roc_auc(scored: DataFrame, label: str, score: str) -> DataFrame:
    """One row with ``auc``: the chance that a positive scores above a negative, ties half.
    Rows are first added up per score, then ranked by running sums over ranges of scores."""
    by = scored.groupBy(F.col(score).cast("double").alias("x")).agg(
        F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("pos"), F.sum(F.when(F.col(label) == 1, 0).otherwise(1)).alias("neg"))
    ranked = running_sums(by, "x", ["neg"])
    won = F.sum(F.col("pos") * (F.col("neg_upto") - F.col("neg") / 2))
    pairs = F.sum("pos").cast("double") * F.sum("neg")
    return ranked.agg(F.when(pairs > 0, won / pairs).alias("auc"))


def residual_gains(assigned: DataFrame, feature: str, score: Column | None = None, label: str = "label", folds: int = 3, leaf: int = LEAF) -> list[float]:
    """Brier improvement per fold of adding one shrunken stump to the fold's baseline, or to
    ``score`` (a logit) where an active set gives one."""
    gains = []
    bases = {r.fold: r.intercept for r in fold_baselines(assigned, label).collect()}
    for k in range(folds):
        at = score if score is not None else F.lit(bases[k])
        part = assigned.filter(F.col("fold") == k).withColumn("__at", at).withColumn("__p", sigmoid(F.col("__at")))
        y = F.col(label).cast("double")
        part = part.withColumn("__w", newton_weight(F.col("__p"))).withColumn("__r", newton_response(y, F.col("__p")))
        stump, _ = fit_stump(part.filter("role = 'train'"), feature, "__w", "__r", leaf)
        after = sigmoid(F.col("__at") + SHRINKAGE * stump)
        row = part.filter("role = 'valid'").agg(brier(y, F.col("__p")).alias("b"), brier(y, after).alias("c")).first()
        gains.append(0.0 if row.b is None or row.b <= 1e-12 else 1 - row.c / row.b)
    return gains


def rank_table(df: DataFrame, column: str, out: str) -> DataFrame:
    """(__x, ``out``): tie-averaged ranks, from 1, of the distinct values of a column."""
    by = df.groupBy(F.col(column).cast("double").alias("__x")).agg(F.count("*").alias("__n"))
    return running_sums(by, "__x", ["__n"]).select("__x", (F.col("__n_upto") - (F.col("__n") - 1) / 2).alias(out))


def average_ranks(df: DataFrame, column: str, out: str) -> DataFrame:
    """Add tie-averaged ranks of a column without nulls."""
    ranks = rank_table(df, column, out)
    return df.join(ranks, df[column].cast("double") == ranks["__x"]).drop("__x")


def spearman_pairs(df: DataFrame, columns: list[str]) -> DataFrame:
    """(left, right, rho) for every ordered pair: ranks of each column come from the input, then
    one aggregation serves all pairs; constant columns give null."""
    base = df.select(*columns).persist()
    ranked = base
    for c in columns:
        ranks = rank_table(base, c, f"__rank_{c}")
        ranked = ranked.join(ranks, ranked[c].cast("double") == ranks["__x"]).drop("__x")
    pair = lambda a, b: F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), safe_corr(f"__rank_{a}", f"__rank_{b}").alias("rho"))
    listed = ranked.agg(F.array(*(pair(a, b) for a in columns for b in columns)).alias("p")).select(F.explode("p").alias("p")).select("p.*")
    return listed
