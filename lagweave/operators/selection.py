"""Selection among scored candidates: quality, correlation, Pareto fronts, shortlists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import finite, safe_corr
from .prefix import running_max

BLOCK = 10_000  # vectors that may be broadcast
ROUNDS = 3


def dominates(a: list[Column], b: list[Column], maximize: list[bool]) -> Column:
    """``a`` is nowhere worse and somewhere better."""
    no_worse = reduce(lambda x, y: x & y, (p >= q if up else p <= q for p, q, up in zip(a, b, maximize, strict=True)))
    better = reduce(lambda x, y: x | y, (p > q if up else p < q for p, q, up in zip(a, b, maximize, strict=True)))
    return no_worse & better


def pareto_front(df: DataFrame, objectives: list[str], maximize: list[bool], block: int = BLOCK) -> DataFrame:
    """Rows with finite objectives that no row dominates.

    Distinct vectors are first reduced by fronts within random groups of about ``block``: what a
    group's front dominates, the whole front does.  The vectors left, few unless the front
    itself is large, are compared with each other: broadcast if they are at most ``block``,
    else cut into groups of that size, each pair of groups in a task."""
    ok = df.filter(reduce(lambda x, y: x & y, (finite(F.col(c)) for c in objectives)))
    names = [f"__{c}" for c in objectives]
    beats = lambda side: dominates([F.col(f"_{side}{c}") for c in objectives], [F.col(c) for c in names], maximize)
    renamed = lambda frame, *more: frame.select(*more, *(F.col(n).alias(f"_r{c}") for n, c in zip(names, objectives, strict=True)))
    left = ok.select(*(F.col(c).alias(n) for c, n in zip(objectives, names, strict=True))).distinct().persist()
    held, n, salt = [left], left.count(), 0
    while n > block and salt < ROUNDS:
        salt += 1
        grouped = left.withColumn(" group", F.pmod(F.xxhash64(F.lit(salt), *names), F.lit(-(-n // block))))
        other = renamed(grouped, F.col("` group`").alias(" of"))
        left = grouped.join(other, (F.col("` group`") == F.col("` of`")) & beats("r"), "left_anti").select(*names).persist()
        held.append(left)
        n, before = left.count(), n
        if n > 0.9 * before:  # nearly all of it is front
            break
    if n <= block:
        front = left.join(F.broadcast(renamed(left)), beats("r"), "left_anti")
    else:
        parts = -(-n // block)
        every = F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
        own = left.withColumn(" group", F.pmod(F.xxhash64(*names), F.lit(parts)).cast("int"))
        asked, asking = own.withColumn(" against", every), renamed(own.withColumn(" with", every), F.col("` with`").alias(" of"), F.col("` group`").alias(" to"))
        beaten = asked.join(asking, (F.col("` group`") == F.col("` of`")) & (F.col("` against`") == F.col("` to`")) & beats("r"), "left_semi").select(*(F.col(c).alias(f"{c}b") for c in names)).distinct()
        front = left.join(beaten, reduce(lambda x, y: x & y, (F.col(c) == F.col(f"{c}b") for c in names)), "left_anti")
    for used in held[:-1]:
        used.unpersist()
    return ok.join(front, reduce(lambda x, y: x & y, (F.col(c) == F.col(n) for c, n in zip(objectives, names, strict=True))), "left_semi")


def quality_filter(df: DataFrame, folds: list[str], least: float = 0.001) -> DataFrame:
    return df.filter(F.least(*folds) >= least)


def shortlist(df: DataFrame, folds: list[str], tiebreak: str, n: int = 50) -> DataFrame:
    """The ``n`` rows with the best worst fold; earlier admission first on ties."""
    return df.withColumn("proxy", F.least(*folds)).orderBy(F.desc("proxy"), tiebreak).limit(n)


def promotion(df: DataFrame, gains: list[str], seconds: str, tiebreak: str, least_mean: float = 0.0005) -> DataFrame:
    """The row to promote: no fold loses, the mean gains enough; the best worst fold, then mean,
    then cost."""
    mean = reduce(lambda a, b: a + b, map(F.col, gains)) / len(gains)
    ok = df.withColumn("worst", F.least(*gains)).withColumn("mean_gain", mean).filter((F.col("worst") >= 0) & (F.col("mean_gain") >= least_mean))
    return ok.orderBy(F.desc("worst"), F.desc("mean_gain"), F.asc(seconds), tiebreak).limit(1)


def sweep_front(df: DataFrame, x: str, y: str) -> DataFrame:
    """Two-dimensional front: no cheaper row has as much ``y``.  Rows are first reduced to the
    best per cost."""
    best = df.filter(F.col(x).isNotNull()).groupBy(x).agg(F.max(y).alias(y))
    return running_max(best, x, y, "before").filter(F.col("before").isNull() | (F.col(y) > F.col("before"))).drop("before")


def correlations(df: DataFrame, candidate: str, references: list[str]) -> DataFrame:
    """(reference, r): absolute Pearson correlation with each reference, in one aggregation."""
    pairs = [F.struct(F.lit(i).alias("ord"), F.lit(c).alias("reference"), F.abs(safe_corr(candidate, c)).alias("r")) for i, c in enumerate(references)]
    return df.agg(F.array(*pairs).alias("p")).select(F.explode("p").alias("p")).select("p.*")


def usable_signal(df: DataFrame, column: str) -> str | None:
    """Why a signal cannot be compared: 'empty', 'nonfinite', 'constant'; None if it can."""
    row = df.agg(F.count("*").alias("n"), F.sum((~F.coalesce(finite(F.col(column)), F.lit(False))).cast("int")).alias("bad"), F.stddev_pop(column).alias("std")).first()
    if not row.n:
        return "empty"
    if row.bad:
        return "nonfinite"
    return "constant" if row.std is None or row.std <= 1e-12 else None


def first_correlated(df: DataFrame, candidate: str, references: list[str], threshold: float) -> tuple[str | None, float]:
    """The first reference at or above the threshold (with 1e-12 slack), or None and the largest."""
    rows = sorted(correlations(df, candidate, references).collect(), key=lambda r: r.ord) if references else []
    largest = 0.0
    for r in rows:
        value = 0.0 if r.r is None or r.r != r.r else r.r
        if value + 1e-12 >= threshold:
            return r.reference, value
        largest = max(largest, value)
    return None, largest
