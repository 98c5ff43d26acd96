"""Figure tables and run statistics over a stand-in run table made from ``orders``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import selection
from ..operators import statistics as st
from ..plans import comparison
from .inputs import table

STATUSES = ["F", "O", "P"]
RUN_SQL = """run AS (SELECT o_orderkey AS idx, CAST(o_orderkey % 10 AS INTEGER) AS generation, o_orderstatus AS status, CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE (o_orderkey * 37 % 1000) / 1000.0::DOUBLE END AS s1,
  (o_orderkey * 53 % 1000) / 1000.0::DOUBLE AS s2, CASE WHEN o_orderkey % 13 = 0 OR o_orderkey % 7 = 0 THEN NULL ELSE (o_orderkey * 71 % 1000) / 1000.0::DOUBLE END AS s3,
  (o_orderkey * 19 % 400) / 8.0::DOUBLE AS seconds, o_orderpriority AS strategy FROM orders)"""


def run_table(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    part = lambda m: ((k * m) % 1000) / F.lit(1000.0)
    return o.select(k.alias("idx"), (k % 10).cast("int").alias("generation"), F.col("o_orderstatus").alias("status"), F.when(k % 13 != 0, part(37)).alias("s1"), part(53).alias("s2"),
                    F.when((k % 13 != 0) & (k % 7 != 0), part(71)).alias("s3"), ((k * 19 % 400) / F.lit(8.0)).alias("seconds"), F.col("o_orderpriority").alias("strategy"))


FOLDS = ["s1", "s2", "s3"]
MEAN = "list_avg(list_filter([s1, s2, s3], lambda x: x IS NOT NULL))"


def generation_iqr(spark, sf_dir):
    return st.quartiles(run_table(spark, sf_dir), "generation", "seconds")


def fold_stability(spark, sf_dir):
    return st.row_spread(run_table(spark, sf_dir), FOLDS).groupBy("generation").agg(F.count("fold_sd").alias("n"), F.round(F.avg("fold_sd"), 8).alias("mean_sd"), F.round(F.max("fold_sd"), 8).alias("max_sd"))


def candidate_outcomes_pivot(spark, sf_dir):
    return st.outcome_table(run_table(spark, sf_dir), "generation", "status", STATUSES)


def score_by_generation(spark, sf_dir):
    done = st.scores_by_generation(run_table(spark, sf_dir), "generation", FOLDS)
    return done.select("generation", F.round("best", 8).alias("best"), F.round("median", 8).alias("median"))


def cumulative_evaluations(spark, sf_dir):
    by = run_table(spark, sf_dir).groupBy("generation").agg(F.sum(F.when(F.col("status") == "F", 1).otherwise(0)).cast("long").alias("evaluated"))
    return st.progress(by, "generation", "evaluated")


PATTERNS = {"small": "small", "red": "red", "widget": "widget", "absent": "no such word"}


def presence_counts(spark, sf_dir):
    return st.presence_counts(table(spark, sf_dir, "part"), "p_name", PATTERNS)


def diagnostics_aggregates(spark, sf_dir):
    df = run_table(spark, sf_dir).withColumn("dependencies", F.concat_ws("; ", "strategy", "status", F.lit("")))
    return st.diagnostics(df, "generation", "seconds", "dependencies")


def strategy_medians(spark, sf_dir):
    return run_table(spark, sf_dir).groupBy("strategy").agg(F.count("*").alias("n"), F.median("seconds").alias("median_seconds"), F.round(F.median("s2"), 8).alias("median_score"))


def pareto_sweep_2d(spark, sf_dir):
    return selection.sweep_front(run_table(spark, sf_dir), "seconds", "s2")


def mann_whitney_u(spark, sf_dir):
    return st.rank_biserial(run_table(spark, sf_dir), "strategy", "1-URGENT", "5-LOW", "s2").select("u", F.round("effect", 8).alias("effect"), "n1", "n2")


def strategy_pairs(spark, sf_dir):
    """U and effect of every pair of strategies; the SQL has no error function for p-values."""
    done = comparison.pair_tests(run_table(spark, sf_dir), "strategy", "seconds")
    return done.select("left", "right", "n_left", "n_right", "median_left", "median_right", "u_statistic", F.round("rank_biserial", 8).alias("rank_biserial"))


def kruskal_h(spark, sf_dir):
    done = st.kruskal(run_table(spark, sf_dir), "strategy", "seconds")
    return done.select(F.round("h", 6).alias("h"), "groups", F.col("n").cast("long").alias("n"))


def holm_adjust(spark, sf_dir):
    return st.holm(table(spark, sf_dir, "supplier").select("s_suppkey", ((F.col("s_suppkey") * 29 % 101) / F.lit(20000.0)).alias("p")), "p", "s_suppkey").select("s_suppkey", "p", F.round("adjusted", 10).alias("adjusted"))


def score_versus_time(spark, sf_dir):
    return run_table(spark, sf_dir).withColumn("score", F.round(st.row_mean(FOLDS), 8)).filter("score is not null and seconds is not null").select("idx", "score", "seconds")


def importance_top20(spark, sf_dir):
    return run_table(spark, sf_dir).select("idx", "s2").orderBy(F.desc("s2"), "idx").limit(20)


NATION_SQL = "c AS (SELECT c_nationkey AS id, max(c_acctbal) AS a, min(c_acctbal) AS b, count(*)::DOUBLE AS d, median(c_acctbal) AS s FROM customer GROUP BY 1)"


def _candidates(spark, sf_dir):
    return table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("id")).agg(F.max("c_acctbal").alias("a"), F.min("c_acctbal").alias("b"), F.count("*").cast("double").alias("d"), F.median("c_acctbal").alias("s"))


def pareto_front(spark, sf_dir):
    return selection.pareto_front(_candidates(spark, sf_dir), ["a", "b", "d", "s"], [True, True, True, False]).select("id", "a", "b", "d", F.round("s", 6).alias("s"))


def archive_admission(spark, sf_dir):
    """Admit the candidates of ids 12 and above that lie on the front of all; older members stay."""
    every = _candidates(spark, sf_dir)
    front = selection.pareto_front(every, ["a", "b", "d", "s"], [True, True, True, False])
    kept = every.filter("id < 12").select("id", F.lit(False).alias("admitted"))
    return kept.unionByName(front.filter("id >= 12").select("id", F.lit(True).alias("admitted")))


def quality_filter(spark, sf_dir):
    return selection.quality_filter(run_table(spark, sf_dir).filter("s1 is not null and s3 is not null"), FOLDS, 0.4).select("idx", *FOLDS)


def proxy_shortlist_topk(spark, sf_dir):
    return selection.shortlist(run_table(spark, sf_dir).filter("s1 is not null and s3 is not null"), FOLDS, "idx").select("idx", "proxy")


def promotion_argmax(spark, sf_dir):
    return selection.promotion(run_table(spark, sf_dir).filter("s1 is not null and s3 is not null"), FOLDS, "seconds", "idx").select("idx", "worst", F.round("mean_gain", 8).alias("mean_gain"))


QUERIES = {f.__name__: f for f in (generation_iqr, fold_stability, candidate_outcomes_pivot, score_by_generation, cumulative_evaluations, presence_counts, diagnostics_aggregates, strategy_medians, pareto_sweep_2d,
                                   mann_whitney_u, strategy_pairs, kruskal_h, holm_adjust, score_versus_time, importance_top20, pareto_front, archive_admission, quality_filter, proxy_shortlist_topk, promotion_argmax)}
_DOM = "EXISTS (SELECT 1 FROM c y WHERE y.a >= x.a AND y.b >= x.b AND y.d >= x.d AND y.s <= x.s AND (y.a > x.a OR y.b > x.b OR y.d > x.d OR y.s < x.s))"
ORACLES = {
    "generation_iqr": f"WITH {RUN_SQL} SELECT generation, count(*) AS n, quantile_cont(seconds, 0.25) AS q1, quantile_cont(seconds, 0.5) AS median, quantile_cont(seconds, 0.75) AS q3 FROM run GROUP BY generation",
    "fold_stability": f"""WITH {RUN_SQL}, d AS (SELECT generation, CASE WHEN len(v) > 1 THEN sqrt(list_sum(list_transform(v, lambda x: (x - list_avg(v)) * (x - list_avg(v)))) / len(v)) END AS sd
      FROM (SELECT generation, list_filter([s1, s2, s3], lambda x: x IS NOT NULL) AS v FROM run)) SELECT generation, count(sd) AS n, round(avg(sd), 8) AS mean_sd, round(max(sd), 8) AS max_sd FROM d GROUP BY generation""",
    "candidate_outcomes_pivot": f"WITH {RUN_SQL} SELECT generation, " + ", ".join(f"count(*) FILTER (WHERE status = '{s}') AS {s}" for s in STATUSES) + " FROM run GROUP BY generation",
    "score_by_generation": f"WITH {RUN_SQL} SELECT generation, round(max({MEAN}), 8) AS best, round(median({MEAN}), 8) AS median FROM run GROUP BY generation",
    "cumulative_evaluations": f"WITH {RUN_SQL}, g AS (SELECT generation, count(*) FILTER (WHERE status = 'F') AS evaluated FROM run GROUP BY generation) SELECT generation, evaluated, sum(evaluated) OVER (ORDER BY generation)::BIGINT AS cumulative FROM g",
    "presence_counts": " UNION ALL ".join(f"SELECT '{k}' AS name, count(*) AS n FROM part WHERE contains(p_name, '{p}') HAVING count(*) > 0" for k, p in PATTERNS.items()),
    "diagnostics_aggregates": f"WITH {RUN_SQL} SELECT max(generation) AS generations, sum(seconds) AS seconds, (SELECT count(*) FROM (SELECT strategy FROM run UNION SELECT status FROM run)) AS dependencies FROM run",
    "strategy_medians": f"WITH {RUN_SQL} SELECT strategy, count(*) AS n, median(seconds) AS median_seconds, round(median(s2), 8) AS median_score FROM run GROUP BY strategy",
    "pareto_sweep_2d": f"WITH {RUN_SQL}, b AS (SELECT seconds, max(s2) AS s2 FROM run GROUP BY seconds) SELECT seconds, s2 FROM b x WHERE NOT EXISTS (SELECT 1 FROM b y WHERE y.seconds < x.seconds AND y.s2 >= x.s2)",
    "mann_whitney_u": f"""WITH {RUN_SQL}, t AS (SELECT strategy, rank() OVER (ORDER BY s2) + (count(*) OVER (PARTITION BY s2) - 1) / 2.0 AS r FROM run WHERE strategy IN ('1-URGENT', '5-LOW')),
      s AS (SELECT sum(r) FILTER (WHERE strategy = '1-URGENT')::DOUBLE AS r, count(*) FILTER (WHERE strategy = '1-URGENT') AS n1, count(*) FILTER (WHERE strategy = '5-LOW') AS n2 FROM t)
      SELECT r - n1 * (n1 + 1) / 2 AS u, round(2 * (r - n1 * (n1 + 1) / 2) / (n1 * n2) - 1, 8) AS effect, n1, n2 FROM s""",
    "strategy_pairs": f"""WITH {RUN_SQL}, p AS (SELECT a.strategy AS "left", b.strategy AS "right", count(DISTINCT a.idx) AS n_left, count(DISTINCT b.idx) AS n_right,
        sum(CASE WHEN a.seconds > b.seconds THEN 1.0 WHEN a.seconds = b.seconds THEN 0.5 ELSE 0.0 END)::DOUBLE AS u FROM run a JOIN run b ON a.strategy < b.strategy GROUP BY 1, 2),
      m AS (SELECT strategy, median(seconds) AS median FROM run GROUP BY strategy)
      SELECT "left", "right", n_left, n_right, x.median AS median_left, y.median AS median_right, u AS u_statistic, round(2 * u / (n_left * n_right) - 1, 8) AS rank_biserial
      FROM p JOIN m x ON x.strategy = "left" JOIN m y ON y.strategy = "right" """,
    "kruskal_h": f"""WITH {RUN_SQL}, t AS (SELECT strategy, seconds, (rank() OVER (ORDER BY seconds) + (count(*) OVER (PARTITION BY seconds) - 1) / 2.0)::DOUBLE AS r FROM run),
      k AS (SELECT strategy, sum(r) AS r, count(*) AS n FROM t GROUP BY strategy), z AS (SELECT sum(c::DOUBLE * c * c - c) AS ties FROM (SELECT count(*) AS c FROM t GROUP BY seconds)),
      s AS (SELECT sum(n)::DOUBLE AS n, sum(r * r / n) AS q, count(*) AS groups FROM k)
      SELECT round((12.0 / (n * (n + 1)) * q - 3 * (n + 1)) / (1 - ties / (n * n * n - n)), 6) AS h, groups, n::BIGINT AS n FROM s, z""",
    "holm_adjust": """WITH s AS (SELECT s_suppkey, (s_suppkey * 29 % 101) / 20000.0::DOUBLE AS p FROM supplier), r AS (SELECT *, p * (count(*) OVER () - row_number() OVER (ORDER BY p, s_suppkey) + 1) AS raw FROM s)
      SELECT s_suppkey, p, round(least(1.0, max(raw) OVER (ORDER BY p, s_suppkey ROWS UNBOUNDED PRECEDING)), 10) AS adjusted FROM r""",
    "score_versus_time": f"WITH {RUN_SQL} SELECT idx, round({MEAN}, 8) AS score, seconds FROM run WHERE {MEAN} IS NOT NULL",
    "importance_top20": f"WITH {RUN_SQL} SELECT idx, s2 FROM run ORDER BY s2 DESC, idx LIMIT 20",
    "pareto_front": f"WITH {NATION_SQL} SELECT id, a, b, d, round(s, 6) AS s FROM c x WHERE NOT {_DOM}",
    "archive_admission": f"WITH {NATION_SQL} SELECT id, false AS admitted FROM c WHERE id < 12 UNION ALL SELECT id, true FROM c x WHERE id >= 12 AND NOT {_DOM}",
    "quality_filter": f"WITH {RUN_SQL} SELECT idx, s1, s2, s3 FROM run WHERE s1 IS NOT NULL AND s3 IS NOT NULL AND least(s1, s2, s3) >= 0.4",
    "proxy_shortlist_topk": f"WITH {RUN_SQL} SELECT idx, least(s1, s2, s3) AS proxy FROM run WHERE s1 IS NOT NULL AND s3 IS NOT NULL ORDER BY proxy DESC, idx LIMIT 50",
    "promotion_argmax": f"""WITH {RUN_SQL} SELECT idx, least(s1, s2, s3) AS worst, round((s1 + s2 + s3) / 3, 8) AS mean_gain FROM run WHERE s1 IS NOT NULL AND s3 IS NOT NULL
      AND (s1 + s2 + s3) / 3 >= 0.0005 ORDER BY worst DESC, (s1 + s2 + s3) / 3 DESC, seconds, idx LIMIT 1""",
}
