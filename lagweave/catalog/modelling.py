"""Folds, baselines, stumps, scores, forests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import newton_response, newton_weight, sigmoid
from ..functions.windows import DAY, Primitive
from ..operators import evaluation as ev
from ..operators import forest, selection
from ..operators.asof import event_features
from .history import J, sql_value
from .inputs import EV, TX, event_spine, event_transactions

FEATURES = {"mean_7d": Primitive("mean", "time", 7 * DAY), "count_total": Primitive("count_total", "time", -1), "max_row": Primitive("max", "row", 5), "daily": Primitive("avg_daily_amount", "days", 7)}
FOLDS = 3
FEATURE_SQL = ", ".join(f"round(coalesce({sql_value(p)}, 0.0), 6) AS {n}" for n, p in FEATURES.items())
F_SQL = f"f AS (SELECT id, {FEATURE_SQL} FROM j GROUP BY id), e AS (SELECT ev.id, ev.t, ev.label, ev.split, f.* EXCLUDE (id) FROM ev JOIN f USING (id))"
FOLD_SQL = f"""g AS (SELECT *, dense_rank() OVER (ORDER BY t) - 1 AS grp FROM e WHERE split = 'train'), n AS (SELECT count(DISTINCT t) AS n, count(DISTINCT t) // {FOLDS + 1} AS size FROM g),
b AS (SELECT k AS fold, n - ({FOLDS} - k) * size AS lo, n - ({FOLDS} - k - 1) * size AS hi FROM n, range({FOLDS}) r(k)),
a AS (SELECT g.*, CAST(fold AS INTEGER) AS fold, CASE WHEN grp < lo THEN 'train' ELSE 'valid' END AS role FROM g, b WHERE grp < hi)"""
BASE_SQL = "base AS (SELECT fold, least(greatest(avg(label::DOUBLE), 1e-6), 1 - 1e-6) AS p FROM a WHERE role = 'train' GROUP BY fold)"


def feature_table(spark, sf_dir):
    done = event_features(event_transactions(spark, sf_dir), event_spine(spark, sf_dir), FEATURES.values(), keep=("t", "label", "split"))
    return done.select("id", "t", "label", "split", *(F.round(F.coalesce(F.col(f"`{p.name}`"), F.lit(0.0)), 6).alias(n) for n, p in FEATURES.items()))


def train_folds(spark, sf_dir):
    train = feature_table(spark, sf_dir).filter("split = 'train'")
    return ev.assign_folds(train, FOLDS)


def ts_folds(spark, sf_dir):
    return train_folds(spark, sf_dir).groupBy("fold", "role").agg(F.count("*").alias("rows"), F.min("grp").cast("long").alias("first_group"), F.max("grp").cast("long").alias("last_group"), F.sum("label").cast("long").alias("positives"))


def fold_baseline(spark, sf_dir):
    return ev.fold_baselines(train_folds(spark, sf_dir)).select("fold", "n_train", F.round("base", 8).alias("base"), F.round("intercept", 8).alias("intercept"))


def _residuals(spark, sf_dir):
    folds = train_folds(spark, sf_dir)
    bases = ev.fold_baselines(folds).select(F.col("fold").alias("__fold"), F.col("base").alias("p"))
    joined = folds.join(bases, folds["fold"] == bases["__fold"]).drop("__fold")
    return joined.withColumn("w", newton_weight(F.col("p"))).withColumn("r", newton_response(F.col("label").cast("double"), F.col("p")))


def stump_split(spark, sf_dir):
    """The split of the last fold's training rows on the mean amount; no row where there is none."""
    rows = _residuals(spark, sf_dir).filter("fold = 2 and role = 'train'").persist()  # read by several jobs
    s = ev.best_split(rows, "mean_7d", "w", "r")
    rows.unpersist()
    rows = [] if s is None else [tuple(round(s[k], 6) for k in ("threshold", "left", "right"))]
    return spark.createDataFrame(rows, "threshold double, left_value double, right_value double")


def brier_improvement(spark, sf_dir):
    """Of a score that leans on the count by a fixed coefficient, per fold."""
    valid = _residuals(spark, sf_dir).filter("role = 'valid'")
    y = F.col("label").cast("double")
    q = sigmoid(F.ln(F.col("p") / (1 - F.col("p"))) + 0.2 * (F.col("count_total") / 10 - 1))
    by = valid.groupBy("fold").agg(ev.brier(y, F.col("p")).alias("b"), ev.brier(y, q).alias("c"))
    return by.select("fold", F.round("b", 8).alias("baseline"), F.round("c", 8).alias("corrected"), F.round(ev.relative_improvement(F.col("c"), F.col("b")), 6).alias("gain"))


def roc_auc(spark, sf_dir):
    return ev.roc_auc(feature_table(spark, sf_dir), "label", "count_total").select(F.round("auc", 8).alias("auc"))


def additive_scores(spark, sf_dir):
    """One stump on the whole training split, then the AUC on the test split."""
    table = feature_table(spark, sf_dir).persist()  # read by several jobs
    train = table.filter("split = 'train'")
    mean = train.agg(F.avg(F.col("label").cast("double"))).first()[0]
    p = F.lit(mean)
    rows = train.withColumn("w", newton_weight(p)).withColumn("r", newton_response(F.col("label").cast("double"), p))
    stump, _ = ev.fit_stump(rows, "mean_7d", "w", "r")
    done = ev.roc_auc(table.filter("split = 'test'").withColumn("score", F.round(ev.SHRINKAGE * stump, 8)), "label", "score").select(F.round("auc", 8).alias("test_auc")).collect()
    table.unpersist()
    return spark.createDataFrame(done, "test_auc double")


def spearman_matrix(spark, sf_dir):
    return ev.spearman_pairs(feature_table(spark, sf_dir), list(FEATURES)).select(F.col("left").alias("left_feature"), F.col("right").alias("right_feature"), F.round("rho", 8).alias("rho"))


def pearson_filter(spark, sf_dir):
    """Absolute correlation of the mean with the others, and whether it is held against them at 0.85."""
    done = selection.correlations(feature_table(spark, sf_dir), "mean_7d", [n for n in FEATURES if n != "mean_7d"])
    return done.select("reference", F.round("r", 8).alias("r"), (F.col("r") + 1e-12 >= 0.85).alias("rejected"))


def residual_fitness(spark, sf_dir):
    """Brier gains of a shrunken stump per fold."""
    folds = train_folds(spark, sf_dir).persist()
    gains = ev.residual_gains(folds, "mean_7d")
    folds.unpersist()
    return spark.createDataFrame([(k, round(g, 8)) for k, g in enumerate(gains)], "fold int, gain double")


def rf_fitness(spark, sf_dir):
    folds = train_folds(spark, sf_dir).persist()
    rows = []
    for k in range(FOLDS):
        part = folds.filter(F.col("fold") == k)
        model = forest.fit_forest(part.filter("role = 'train'"), list(FEATURES), trees=50, depth=5)
        rows.append((k, forest.forest_auc(model, part.filter("role = 'valid'"), list(FEATURES))))
    return spark.createDataFrame(rows, "fold int, auc double")


def final_rf_importances(spark, sf_dir):
    model = forest.fit_forest(feature_table(spark, sf_dir).filter("split = 'train'"), list(FEATURES), trees=500, depth=10, most_rows=100_000)
    return spark.createDataFrame(forest.importances(model, list(FEATURES)), "feature string, importance double, deviation double")


QUERIES = {f.__name__: f for f in (ts_folds, fold_baseline, stump_split, brier_improvement, roc_auc, additive_scores, spearman_matrix, pearson_filter, residual_fitness, rf_fitness, final_rf_importances)}

_HEAD = f"WITH {TX}, {EV}, {J}, {F_SQL}"
_SPLIT = """u AS (SELECT CAST(CAST({x} AS FLOAT) AS DOUBLE) AS x, count(*) AS n, sum(w) AS w, sum(w * r) AS s FROM z GROUP BY 1),
c AS (SELECT x, lead(x) OVER (ORDER BY x) AS nx, sum(n) OVER o AS nl, sum(w) OVER o AS wl, sum(s) OVER o AS sl, sum(n) OVER () AS nt, sum(w) OVER () AS wt, sum(s) OVER () AS st FROM u WINDOW o AS (ORDER BY x)),
best AS (SELECT *, sl * sl / wl + (st - sl) * (st - sl) / (wt - wl) AS gain FROM c WHERE nl >= 150 AND nt - nl >= 150 ORDER BY round(sl * sl / wl + (st - sl) * (st - sl) / (wt - wl), 9) DESC, x LIMIT 1)"""
_Z = "z AS (SELECT *, greatest(p * (1 - p), 1e-4) AS w, (label - p) / greatest(p * (1 - p), 1e-4) AS r FROM {rows})"
_RANKS = ", ".join(f"(rank() OVER (ORDER BY {n}) + (count(*) OVER (PARTITION BY {n}) - 1) / 2.0)::DOUBLE AS {n}" for n in FEATURES)
_AUC = """s AS (SELECT x, sum(label)::BIGINT AS pos, sum(1 - label)::BIGINT AS neg FROM q GROUP BY x), k AS (SELECT *, sum(neg) OVER (ORDER BY x) AS upto FROM s)
SELECT round(sum(pos * (upto - neg / 2.0))::DOUBLE / (sum(pos)::DOUBLE * sum(neg)::DOUBLE), 8) AS {out} FROM k"""
ORACLES = {
    "ts_folds": f"{_HEAD}, {FOLD_SQL} SELECT fold, role, count(*) AS rows, min(grp)::BIGINT AS first_group, max(grp)::BIGINT AS last_group, sum(label)::BIGINT AS positives FROM a GROUP BY fold, role",
    "fold_baseline": f"{_HEAD}, {FOLD_SQL}, {BASE_SQL}, c AS (SELECT fold, count(*) AS n FROM a WHERE role = 'train' GROUP BY fold) SELECT fold, n AS n_train, round(p, 8) AS base, round(ln(p / (1 - p)), 8) AS intercept FROM base JOIN c USING (fold)",
    "stump_split": f"{_HEAD}, {FOLD_SQL}, {BASE_SQL}, {_Z.format(rows="a JOIN base USING (fold) WHERE fold = 2 AND role = 'train'")}, {_SPLIT.format(x='mean_7d')} SELECT round((x + nx) / 2, 6) AS threshold, round(sl / wl, 6) AS left_value, round((st - sl) / (wt - wl), 6) AS right_value FROM best",
    "brier_improvement": f"""{_HEAD}, {FOLD_SQL}, {BASE_SQL}, v AS (SELECT fold, label, p, ln(p / (1 - p)) + 0.2 * (count_total / 10 - 1) AS x FROM a JOIN base USING (fold) WHERE role = 'valid'),
      q AS (SELECT fold, avg((label - p) * (label - p)) AS b, avg((label - 1 / (1 + exp(-x))) * (label - 1 / (1 + exp(-x)))) AS c FROM v GROUP BY fold)
      SELECT fold, round(b, 8) AS baseline, round(c, 8) AS corrected, round(CASE WHEN b > 1e-12 THEN 1 - c / b ELSE 0 END, 6) AS gain FROM q""",
    "roc_auc": f"{_HEAD}, q AS (SELECT count_total AS x, label FROM e), {_AUC.format(out='auc')}",
    "additive_scores": f"""{_HEAD}, m AS (SELECT avg(label::DOUBLE) AS p FROM e WHERE split = 'train'), {_Z.format(rows="e, m WHERE split = 'train'")}, {_SPLIT.format(x='mean_7d')},
      q AS (SELECT round(0.2 * CASE WHEN x IS NULL THEN 0 WHEN CAST(CAST(mean_7d AS FLOAT) AS DOUBLE) <= (x + nx) / 2 THEN sl / wl ELSE (st - sl) / (wt - wl) END, 8) AS x, label FROM e LEFT JOIN best ON true WHERE split = 'test'), {_AUC.format(out='test_auc')}""",
    "residual_fitness": f"""{_HEAD}, {FOLD_SQL}, {BASE_SQL}, {_Z.format(rows="a JOIN base USING (fold)")},
      u AS (SELECT fold, CAST(CAST(mean_7d AS FLOAT) AS DOUBLE) AS x, count(*) AS n, sum(w) AS w, sum(w * r) AS s FROM z WHERE role = 'train' GROUP BY 1, 2),
      c AS (SELECT fold, x, lead(x) OVER o AS nx, sum(n) OVER o AS nl, sum(w) OVER o AS wl, sum(s) OVER o AS sl, sum(n) OVER (PARTITION BY fold) AS nt, sum(w) OVER (PARTITION BY fold) AS wt, sum(s) OVER (PARTITION BY fold) AS st
        FROM u WINDOW o AS (PARTITION BY fold ORDER BY x)),
      best AS (SELECT *, sl * sl / wl + (st - sl) * (st - sl) / (wt - wl) AS gain FROM c WHERE nl >= 150 AND nt - nl >= 150
        QUALIFY row_number() OVER (PARTITION BY fold ORDER BY round(sl * sl / wl + (st - sl) * (st - sl) / (wt - wl), 9) DESC, x) = 1),
      t AS (SELECT fold, stddev_pop(mean_7d) AS sd, sum(w * r) / sum(w) AS mean FROM z WHERE role = 'train' GROUP BY fold),
      v AS (SELECT z.fold, label, p, ln(p / (1 - p)) + 0.2 * CASE WHEN sd < 1e-8 THEN 0 WHEN x IS NULL THEN t.mean WHEN CAST(CAST(mean_7d AS FLOAT) AS DOUBLE) <= (x + nx) / 2 THEN sl / wl ELSE (st - sl) / (wt - wl) END AS lg
        FROM z JOIN t ON t.fold = z.fold LEFT JOIN best ON best.fold = z.fold WHERE role = 'valid'),
      q AS (SELECT fold, avg((label - p) * (label - p)) AS b, avg((label - 1 / (1 + exp(-lg))) * (label - 1 / (1 + exp(-lg)))) AS c FROM v GROUP BY fold)
      SELECT fold, round(CASE WHEN b > 1e-12 THEN 1 - c / b ELSE 0 END, 8) AS gain FROM q""",
    "spearman_matrix": f"{_HEAD}, k AS (SELECT {_RANKS} FROM e) " + " UNION ALL ".join(f"SELECT '{a}' AS left_feature, '{b}' AS right_feature, round(corr({a}, {b}), 8) AS rho FROM k" for a in FEATURES for b in FEATURES),
    "pearson_filter": f"{_HEAD} " + " UNION ALL ".join(f"SELECT '{n}' AS reference, round(abs(corr(mean_7d, {n})), 8) AS r, abs(corr(mean_7d, {n})) + 1e-12 >= 0.85 AS rejected FROM e" for n in FEATURES if n != "mean_7d"),
}
