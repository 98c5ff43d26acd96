"""Runs side by side: one row a run, tests of every pair of strategies, and their report."""

from __future__ import annotations

import csv
import math
import re
from functools import lru_cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import statistics as st
from ..sources.tables import read_json

SEED = re.compile(r"seed_(\d+)")
RUNS = """seed int, run_group string, strategy string, score double, archive_size double, selected_features double, evaluated double, search_seconds double, final_seconds double,
total_seconds double, seconds_per_candidate double, generations double, materialization_seconds double, dependencies double"""
PAIRS = "left string, right string, n_left long, n_right long, median_left double, median_right double, u_statistic double, p_value double, p_adjusted double, rank_biserial double"


def _number(value) -> float | None:
    try:
        return float(value) if math.isfinite(float(value)) else None
    except (TypeError, ValueError):
        return None


def _diagnostics(path: Path) -> tuple[float | None, float | None, float | None]:
    """Last generation, seconds and number of distinct dependencies of a run's candidates."""
    if not path.exists():
        return None, None, None
    with open(path, encoding="utf-8", newline="") as file:
        rows = list(csv.DictReader(file))
    column = lambda name: [x for x in (_number(r.get(name)) for r in rows) if x is not None]
    needed = {d.strip() for r in rows for d in (r.get("Dependencies") or "").split(";") if d.strip()}
    seconds = column("MaterializationTime")
    return max(column("Generation"), default=None), sum(seconds) if seconds else None, float(len(needed)) if rows and "Dependencies" in rows[0] else None


def _row(summary: Path, diagnostics: Path, group: str, strategy: str, seed: int | None, metric: str) -> tuple:
    doc = read_json(summary)
    part = lambda name: doc.get(name) or {}
    known = _number(part("configuration").get("seed"))
    objectives = doc.get("objectives")
    count = float(len(objectives)) if isinstance(objectives, list) else None
    number = lambda name: count if _number(doc.get(name)) is None else _number(doc.get(name))
    search, final, evaluated = _number(part("timings").get("search_seconds")), _number(part("timings").get("final_evaluation_seconds")), _number(part("counts").get("evaluated"))
    return (int(known) if known is not None else seed, group, strategy, _number(part("final_metrics").get(metric)), number("full_archive_feature_count"), number("selected_feature_count"), evaluated, search, final,
            None if search is None or final is None else search + final, search / evaluated if search is not None and evaluated else None, *_diagnostics(diagnostics))


def run_rows(spark: SparkSession, folder: str | Path, metric: str = "test_roc_auc") -> DataFrame:
    """One row per run with a seed: ``<group>/seed_<n>/summary.json`` beside ``diagnostics.csv``,
    and ``<strategy>-...-summary.json`` beside a csv of its stem."""
    folder, rows = Path(folder), []
    for group in sorted(p for p in folder.iterdir() if p.is_dir()):
        for run in sorted(group.iterdir()):
            if (seed := SEED.fullmatch(run.name)) and (run / "summary.json").exists():
                rows.append(_row(run / "summary.json", run / "diagnostics.csv", group.name, group.name, int(seed[1]), metric))
    for summary in sorted(folder.glob("*-summary.json")):
        stem = summary.name.removesuffix("-summary.json")
        rows.append(_row(summary, folder / f"{stem}.csv", stem.split("-")[0], stem.split("-")[0], None, metric))
    rows = [r for r in rows if r[0] is not None]
    if not rows:
        raise ValueError(f"no runs in {folder}")
    return spark.createDataFrame(rows, RUNS)


def pair_statistics(df: DataFrame, group: str, value: str) -> DataFrame:
    """(left, right, n_left, n_right, u, ties) of every pair of groups: Mann-Whitney U of the left
    one, tied values counting half, and the sum of t^3 - t over ties.

    Every row goes to the pairs of its group; equal values of a pair are added up before a
    running count, so no row is compared with another."""
    ok = df.filter(F.col(group).isNotNull() & F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(F.col(group).alias("g"), F.col(value).cast("double").alias("v"))
    names = sorted(r.g for r in ok.select("g").distinct().collect())  # strategies are few
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    if not pairs:
        return ok.sparkSession.createDataFrame([], "left string, right string, n_left long, n_right long, u double, ties double")
    listed = F.array(*(F.struct(F.lit(a).alias("left"), F.lit(b).alias("right")) for a, b in pairs))
    dealt = ok.select("g", "v", F.explode(F.filter(listed, lambda p: (p["left"] == F.col("g")) | (p["right"] == F.col("g")))).alias("p")).select("g", "v", "p.*")
    mine = F.col("g") == F.col("left")
    by = dealt.groupBy("left", "right", "v").agg(F.sum(mine.cast("long")).alias("a"), F.sum((~mine).cast("long")).alias("b"))
    before = Window.partitionBy("left", "right").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    t = (F.col("a") + F.col("b")).cast("double")
    counted = by.withColumn("below", F.coalesce(F.sum("b").over(before), F.lit(0))).withColumn("t", t)
    return counted.groupBy("left", "right").agg(F.sum("a").alias("n_left"), F.sum("b").alias("n_right"), F.sum(F.col("a") * (F.col("below") + F.col("b") / 2)).cast("double").alias("u"),
                                                F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")).alias("ties"))


@lru_cache(maxsize=None)
def _arrangements(n: int, m: int) -> tuple[int, ...]:
    """How many orders of n and m values have U = 0, 1, ..., n * m."""
    if not n or not m:
        return (1,)
    out = [0] * (n * m + 1)
    for shift, part in ((m, _arrangements(n - 1, m)), (0, _arrangements(n, m - 1))):
        for u, k in enumerate(part):
            out[u + shift] += k
    return tuple(out)


def u_probability(u: float, n: int, m: int, ties: float) -> float | None:
    """Two-sided: exact for up to 8 values on a side without ties, else the normal approximation
    with corrections for ties and continuity; None where all values are equal."""
    top = max(u, n * m - u)
    if min(n, m) <= 8 and not ties:
        counts = _arrangements(n, m)
        return min(1.0, 2 * sum(counts[math.ceil(top) :]) / sum(counts))
    both = n + m
    spread = math.sqrt(max(n * m / 12 * (both + 1 - ties / (both * (both - 1))), 0.0))
    return min(1.0, 2 * st.normal_tail((top - n * m / 2 - 0.5) / spread)) if spread else None


def pair_tests(df: DataFrame, group: str, value: str) -> DataFrame:
    """Every pair of groups with U, its p-value, Holm's adjustment over all pairs, and the
    rank-biserial correlation; one row a pair, and pairs of strategies are few."""
    spark = df.sparkSession
    medians = {r[0]: r[1] for r in df.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).groupBy(group).agg(F.median(value)).collect()}
    rows = sorted(pair_statistics(df, group, value).collect(), key=lambda r: (r.left, r.right))
    ps = [u_probability(r.u, r.n_left, r.n_right, r.ties) for r in rows]
    raw = spark.createDataFrame([(i, p) for i, p in enumerate(ps) if p is not None], "i long, p double")
    adjusted = {r.i: r.adjusted for r in st.holm(raw, "p", "i").collect()}
    out = [(r.left, r.right, r.n_left, r.n_right, float(medians[r.left]), float(medians[r.right]), r.u, p, adjusted.get(i), 2 * r.u / (r.n_left * r.n_right) - 1) for i, (r, p) in enumerate(zip(rows, ps, strict=True))]
    return spark.createDataFrame(out, PAIRS)


def omnibus(df: DataFrame, group: str, value: str) -> tuple[float, float] | None:
    """Kruskal-Wallis H and its p-value; None for fewer than two groups or equal values."""
    row = st.kruskal(df.filter(~F.isnan(F.col(value).cast("double"))), group, value).first()
    if row is None or not row.groups or row.groups < 2 or row.h is None or math.isnan(row.h):
        return None
    return row.h, st.chi2_tail(row.h, row.groups - 1)


METRICS = {"score": "Final score", "materialization_seconds": "Materialisation time (s)", "total_seconds": "Total time (s)", "seconds_per_candidate": "Search time per candidate (s)"}


def comparison_report(runs: DataFrame, metrics: dict[str, str] = METRICS) -> str:
    """Omnibus and pairwise tests of every metric as text."""
    lines = ["Kruskal-Wallis over all strategies; Mann-Whitney U of every pair with Holm's adjustment.",
             "Effect: rank-biserial correlation, positive where the first strategy has the larger values."]
    for column, label in metrics.items():
        lines += ["", f"{label} ({column})"]
        rows = runs.filter(F.col(column).isNotNull()).groupBy("strategy").agg(F.count("*").alias("n"), F.avg(column).alias("mean"), F.median(column).alias("median")).orderBy("strategy").collect()
        if len(rows) < 2:
            lines.append("  fewer than two strategies have values")
            continue
        lines += [f"  {r.strategy}: n={r.n}, mean={r['mean']:.6g}, median={r['median']:.6g}" for r in rows]
        whole = omnibus(runs, "strategy", column)
        lines.append("  Kruskal-Wallis: all values are equal" if whole is None else f"  Kruskal-Wallis: H={whole[0]:.6g}, p={whole[1]:.4g}")
        for r in pair_tests(runs, "strategy", column).orderBy("left", "right").collect():
            p = "p=n/a" if r.p_value is None else f"p={r.p_value:.4g}, adjusted={r.p_adjusted:.4g}"
            lines.append(f"  {r.left} against {r.right}: n=({r.n_left}, {r.n_right}), U={r.u_statistic:.6g}, {p}, effect={r.rank_biserial:.6g}")
    return "\n".join(lines) + "\n"
