"""As-of windows, rolling windows and expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.windows import DAY, HOUR, Primitive
from ..operators.asof import event_features, transaction_features
from ..operators.rolling import sliding_window
from ..plans.expressions import Add, AvgDailyAmount, CategoryRate, CountTotal, Log, MaxAmount, MeanAmount, Mul, SafeDiv, StdAmount, Sub, TotalAmount, enumerate_trees, feature_frame, key, terminal_space, tree_count
from .inputs import EV, ORD, TX, event_spine, event_transactions, order_transactions

WEEK = 7 * DAY
STATUS = "click"
CODES = [[STATUS], [], [], [], []]

J = """j AS (SELECT ev.id, ev.t AS et, tx.t AS tt, tx.v, tx.status, row_number() OVER (PARTITION BY ev.id ORDER BY tx.t DESC, tx.id DESC) AS rk
  FROM ev LEFT JOIN tx ON tx.m = ev.m AND tx.t < ev.t)"""


def _inside(p: Primitive) -> str:
    if p.window_type == "row":
        return f"tt IS NOT NULL AND rk <= {p.window}"
    if p.window_type == "days":
        return f"tt IS NOT NULL AND floor(tt / {DAY}) >= floor(et / {DAY}) - {p.window} + 1"
    return "tt IS NOT NULL" if p.window == -1 else f"tt >= et - {p.window}"


def sql_value(p: Primitive) -> str:
    """The feature over ``j`` grouped by event."""
    inside, both = _inside(p), f"{_inside(p)} AND status = '{p.category_code}'"
    n = f"count(*) FILTER (WHERE {inside})"
    total = f"coalesce(sum(v) FILTER (WHERE {inside}), 0)::DOUBLE"
    squares = f"(sum(v * v) FILTER (WHERE {inside}))::DOUBLE"
    days = float(p.window)
    return {
        "mean": f"CASE WHEN {n} > 0 THEN {total} / {n} END", "max": f"(max(v) FILTER (WHERE {inside}))::DOUBLE",
        "total_amount": total, "count_total": f"({n})::DOUBLE", "count_category": f"(count(*) FILTER (WHERE {both}))::DOUBLE",
        "std": f"CASE WHEN {n} > 0 THEN sqrt(greatest({squares} / {n} - ({total} / {n}) * ({total} / {n}), 0.0)) END",
        "avg_daily_count": f"({n})::DOUBLE / {days}", "avg_daily_count_category": f"(count(*) FILTER (WHERE {both}))::DOUBLE / {days}",
        "avg_daily_amount": f"{total} / {days}", "avg_daily_total_amount": f"{total} / {days}",
        "avg_daily_amount_category": f"coalesce(sum(v) FILTER (WHERE {both}), 0)::DOUBLE / {days}",
    }[p.kind]


def _named(kind, window_type, window):
    return Primitive(kind, window_type, window, *(("status", STATUS) if kind.endswith("category") else ()))


ASOF = {
    "asof_time_count": _named("count_total", "time", WEEK),
    **{f"asof_time_{k}": _named(k, "time", WEEK) for k in ("mean", "max", "total_amount", "std", "count_category")},
    **{f"asof_total_history_{k}": _named(k, "time", -1) for k in ("count_total", "mean", "max", "total_amount", "std", "count_category")},
    **{f"asof_row_{k}": _named(k, "row", 5) for k in ("mean", "max", "total_amount", "std", "count_category")},
    "asof_days_avg_count": _named("avg_daily_count", "days", 7), "asof_days_avg_count_category": _named("avg_daily_count_category", "days", 14),
    "asof_days_avg_amount": _named("avg_daily_amount", "days", 7), "asof_days_avg_amount_category": _named("avg_daily_amount_category", "days", 30),
    "asof_days_avg_total_amount": _named("avg_daily_total_amount", "days", 14),
    "asof_days_max": _named("max", "days", 7), "asof_days_mean": _named("mean", "days", 7), "asof_days_std": _named("std", "days", 7),
    "asof_time_hour_count": _named("count_total", "time", 6 * HOUR),
}


def _asof(p):
    def query(spark, sf_dir):
        done = event_features(event_transactions(spark, sf_dir), event_spine(spark, sf_dir), [p])
        return done.select(F.col("id").alias("event_id"), F.round(F.col(f"`{p.name}`"), 6).alias("value"))
    return query


QUERIES = {name: _asof(p) for name, p in ASOF.items()}
ORACLES = {name: f"WITH {TX}, {EV}, {J} SELECT id AS event_id, round({sql_value(p)}, 6) AS value FROM j GROUP BY id" for name, p in ASOF.items()}

MONTH = 30 * DAY
SELF = """j AS (SELECT a.id, a.t AS et, b.id AS bid, b.t AS tt, b.v, row_number() OVER (PARTITION BY a.id ORDER BY b.t DESC, b.id DESC) AS rk
  FROM o a LEFT JOIN o b ON a.m = b.m AND (b.t < a.t OR (b.t = a.t AND b.id < a.id)))"""
for _agg in ("count", "sum", "mean", "max"):
    for _mode, _span in (("rows", 3), ("time", 6 * MONTH), ("total", 0)):
        def _rolling(spark, sf_dir, agg=_agg, mode=_mode, span=_span):
            df = order_transactions(spark, sf_dir)
            return df.select(F.col("id").alias("o_orderkey"), F.round(sliding_window(df, "m", "t", "id", "amount", agg, mode, span), 6).alias("value"))
        _in = {"rows": f"bid IS NOT NULL AND rk <= {_span}", "time": f"bid IS NOT NULL AND tt >= et - {_span}", "total": "bid IS NOT NULL"}[_mode]
        _n = f"count(*) FILTER (WHERE {_in})"
        _sum = f"(sum(v) FILTER (WHERE {_in}))::DOUBLE"
        _sql = {"count": f"({_n})::DOUBLE", "sum": _sum, "mean": f"CASE WHEN {_n} > 0 THEN {_sum} / {_n} END", "max": f"(max(v) FILTER (WHERE {_in}))::DOUBLE"}[_agg]
        QUERIES[f"rolling_{_agg}_{_mode}"] = _rolling
        ORACLES[f"rolling_{_agg}_{_mode}"] = f"WITH {ORD}, {SELF} SELECT id AS o_orderkey, round({_sql}, 6) AS value FROM j GROUP BY id"


def asof_transactions(spark, sf_dir):
    """As of transactions themselves, equal times left out (set with many ties)."""
    ps = [Primitive("count_total", "time", -1), Primitive("total_amount", "time", 180 * DAY)]
    done = transaction_features(order_transactions(spark, sf_dir), ps)
    return done.select(F.col("id").alias("o_orderkey"), F.col(ps[0].name).alias("n_before"), F.round(ps[1].name, 6).alias("amount_before"))


QUERIES["asof_transactions"] = asof_transactions
ORACLES["asof_transactions"] = f"""WITH {ORD} SELECT a.id AS o_orderkey, count(b.id)::DOUBLE AS n_before,
  round(coalesce(sum(b.v) FILTER (WHERE b.t >= a.t - {180 * DAY}), 0)::DOUBLE, 6) AS amount_before
  FROM o a LEFT JOIN o b ON a.m = b.m AND b.t < a.t GROUP BY a.id"""

# windows by index: 12 is time 7 days, 17 all history, 0 the last 5 rows
EXPRESSIONS = {
    "expr_add": Add(MeanAmount(12), CountTotal(8)), "expr_sub": Sub(TotalAmount(0), MaxAmount(12)), "expr_mul_clip": Mul(TotalAmount(17), TotalAmount(17)),
    "expr_safe_div": SafeDiv(MeanAmount(0), CountTotal(3)), "expr_signed_log": Log(Sub(TotalAmount(12), TotalAmount(17))), "expr_category_rate": CategoryRate(0, 0, 8),
    "expr_nested_depth4": Log(Add(SafeDiv(StdAmount(17), MeanAmount(17)), Mul(AvgDailyAmount(0), CategoryRate(0, 0, 3)))),
}


def _sql_tree(e, p) -> tuple[str, bool]:
    """SQL over columns named by primitive, and whether it is single precision."""
    q = lambda x: f'"{x.name}"'
    if isinstance(e, CategoryRate):
        a, b = e.primitives(CODES)
        return f"CAST(CASE WHEN {q(b)} >= 1e-6 THEN {q(a)} / {q(b)} ELSE 0.0 END AS FLOAT)", True
    if isinstance(e, Log):
        x, single = _sql_tree(e.value, p)
        x = f"({x})::DOUBLE"
        text = f"sign({x}) * ln(1 + abs({x}))"
        return (f"CAST({text} AS FLOAT)" if single else text), single
    if isinstance(e, (Add, Sub, Mul, SafeDiv)):
        (a, sa), (b, sb) = _sql_tree(e.left, p), _sql_tree(e.right, p)
        if isinstance(e, SafeDiv):
            return f"CAST(CASE WHEN abs({b}) >= 1e-6 THEN ({a})::DOUBLE / ({b})::DOUBLE ELSE 1.0 END AS FLOAT)", True
        single = sa and sb
        if isinstance(e, Mul):
            text = f"CASE WHEN ({a}) * ({b}) IS NOT NULL THEN least(greatest(({a}) * ({b}), -1e6), 1e6) END"
        else:
            text = f"({a}) {e.sign} ({b})"
        return (f"CAST({text} AS FLOAT)" if single else text), single
    return q(e.primitive(CODES)), False


def _digits(e) -> int:
    """Single precision has seven digits; doubles are rounded where ties do not occur."""
    return 4 if "SafeDiv" in key(e) or "CategoryRate" in key(e) else 9


def _expression(e):
    digits = _digits(e)

    def query(spark, sf_dir):
        done = feature_frame(event_transactions(spark, sf_dir), event_spine(spark, sf_dir), [e], CODES)
        return done.select(F.col("id").alias("event_id"), F.round("x0", digits).alias("value"))
    return query


for _name, _tree in EXPRESSIONS.items():
    QUERIES[_name] = _expression(_tree)
    _ps = {p.name: p for p in _tree.primitives(CODES)}
    _cols = ", ".join(f'{sql_value(p)} AS "{n}"' for n, p in _ps.items())
    ORACLES[_name] = f"WITH {TX}, {EV}, {J}, f AS (SELECT id, {_cols} FROM j GROUP BY id) SELECT id AS event_id, round(({_sql_tree(_tree, _ps)[0]})::DOUBLE, {_digits(_tree)}) AS value FROM f"


def enumerate_terminals(spark, sf_dir):
    """Leaf types and how many leaves each has, for one known status."""
    from collections import Counter

    return spark.createDataFrame(sorted(Counter(type(e).__name__ for e in terminal_space(CODES)).items()), "leaf string, n long")


def enumerate_depth2_count(spark, sf_dir):
    return spark.createDataFrame([(2, sum(1 for _ in enumerate_trees(CODES, 2)), sum(tree_count(CODES, 2)))], "depth int, enumerated long, counted long")


QUERIES["enumerate_terminals"] = enumerate_terminals
ORACLES["enumerate_terminals"] = """SELECT * FROM (VALUES ('AvgDailyAmount', 3::BIGINT), ('AvgDailyAmountCategory', 3), ('AvgDailyCount', 3), ('AvgDailyCountCategory', 3),
  ('AvgDailyTotalAmount', 3), ('CategoryRate', 9), ('CountCategory', 18), ('CountTotal', 9), ('MaxAmount', 18), ('MeanAmount', 18), ('StdAmount', 18), ('TotalAmount', 18)) v(leaf, n)"""
QUERIES["enumerate_depth2_count"] = enumerate_depth2_count
ORACLES["enumerate_depth2_count"] = "SELECT 2 AS depth, (123 + 4 * 123 * 123 + 123)::BIGINT AS enumerated, (123 + 4 * 123 * 123 + 123)::BIGINT AS counted"
