"""Windows and expressions against naive loops and known values."""

import math
import random

import pytest
from pyspark.sql import functions as F

from lagweave.functions.scalars import clipped_product, rate, safe_ratio, signed_log
from lagweave.functions.windows import DAY, HOUR, KINDS, Primitive
from lagweave.operators.asof import event_features, transaction_features, union_frame, value_column
from lagweave.operators.rolling import sliding_window
from lagweave.operators.slices import sliced
from lagweave.plans import expressions as ex

TX = "m long, t long, id long, amount double, status string"


def frames(spark, tx, ev):
    return spark.createDataFrame(tx, TX), spark.createDataFrame(ev, "m long, t long, id long")


def values(df, name):
    return [r[name] for r in df.orderBy("id").collect()]


def test_time_window_excludes_the_event_and_includes_the_left_edge(spark):
    tx, ev = frames(spark, [(1, 0, 1, 1.0, "a"), (1, 10, 2, 2.0, "a"), (1, 20, 3, 4.0, "b"), (2, 5, 4, 8.0, "a")], [(1, 20, 0), (1, 21, 1), (2, 5, 2), (2, 6, 3), (9, 50, 4)])
    count, total = Primitive("count_total", "time", 20), Primitive("total_amount", "time", 10)
    got = event_features(tx, ev, [count, total])
    assert values(got, count.name) == [2.0, 2.0, 0.0, 1.0, 0.0]
    assert values(got, total.name) == [2.0, 4.0, 0.0, 8.0, 0.0]


def naive(tx, e, p):
    before = sorted((r for r in tx if r[0] == e[0] and r[1] < e[1]), key=lambda r: (r[1], r[2]))
    if p.window_type == "row":
        before = before[-p.window:]
    elif p.window_type == "time" and p.window != -1:
        before = [r for r in before if r[1] >= e[1] - p.window]
    elif p.window_type == "days":
        before = [r for r in before if r[1] // DAY >= e[1] // DAY - p.window + 1]
    x = [r[3] for r in before]
    cat = [r[3] for r in before if r[4] == p.category_code]
    if p.kind in ("mean", "max", "std"):
        if not x:
            return None
        mean = sum(x) / len(x)
        return {"mean": mean, "max": max(x), "std": math.sqrt(max(sum(v * v for v in x) / len(x) - mean * mean, 0))}[p.kind]
    return {"total_amount": sum(x), "count_total": len(x), "count_category": len(cat), "avg_daily_count": len(x) / p.window, "avg_daily_count_category": len(cat) / p.window,
            "avg_daily_amount": sum(x) / p.window, "avg_daily_total_amount": sum(x) / p.window, "avg_daily_amount_category": sum(cat) / p.window}[p.kind]


@pytest.fixture(scope="module")
def random_rows():
    rng = random.Random(11)
    tx = [(rng.randrange(4), rng.randrange(-3 * DAY, 8 * DAY) // (6 * HOUR) * (6 * HOUR), i, float(rng.randrange(1, 500)) / 4, rng.choice("ab")) for i in range(160)]
    ev = [(rng.randrange(5), rng.randrange(-3 * DAY, 9 * DAY) // (3 * HOUR) * (3 * HOUR), i) for i in range(50)]
    return tx, ev


def test_every_kind_and_window_equals_a_naive_loop(spark, random_rows):
    tx, ev = random_rows
    windows = [("time", 30 * HOUR), ("time", -1), ("row", 3), ("days", 2)]
    ps = [Primitive(k, w, n, *(("status", "a") if k.endswith("category") else ())) for k in KINDS for w, n in windows]
    got = event_features(*frames(spark, tx, ev), ps).orderBy("id").collect()
    for e, r in zip(ev, got, strict=True):
        for p in ps:
            want = naive(tx, e, p)
            assert (r[p.name] is None) if want is None else r[p.name] == pytest.approx(want, abs=1e-6), (e, p)


@pytest.mark.parametrize("amount", ["double", "decimal(12,2)"])
@pytest.mark.parametrize("windows", [[("time", 30 * HOUR), ("time", -1), ("row", 3), ("days", 2)], [("row", 25), ("time", -1)], [("time", 7 * HOUR)], [("time", -1)], [("row", 1)], [("days", 1)]])
def test_hot_merchants_in_slices_equal_a_naive_loop(spark, random_rows, windows, amount):
    """A merchant with most rows, one just hot, cold ones, one without a name; ties across cuts."""
    rng = random.Random(5)
    tx, ev = random_rows
    tx = tx + [(1, rng.choice((rng.randrange(-3 * DAY, 30 * DAY), DAY, 2 * DAY + 1)), 1000 + i, rng.randrange(1, 400) / 4, rng.choice("ab")) for i in range(400)]
    tx = tx + [(None, rng.randrange(0, 9 * DAY), 2000 + i, 1.25, "a") for i in range(90)]
    ev = ev + [(rng.choice((1, None)), rng.choice((rng.randrange(-4 * DAY, 31 * DAY), DAY, DAY + 1)), 100 + i) for i in range(60)]
    ps = [Primitive(k, w, n, *(("status", "a") if k.endswith("category") else ())) for k in KINDS for w, n in windows]
    left, right = frames(spark, tx, ev)
    cut = event_features(left.withColumn("amount", F.col("amount").cast(amount)), right, ps, hot_rows=60, slice_rows=30)
    assert "__slice" in cut._jdf.queryExecution().analyzed().toString()
    got = cut.orderBy("id").collect()
    for e, r in zip(ev, got, strict=True):
        assert r.id == e[2]
        for p in ps:
            want = naive(tx, e, p)
            assert (r[p.name] is None) if want is None else r[p.name] == pytest.approx(want, abs=1e-5), (e, p)


def test_slices_take_any_family_and_code(spark):
    tx = spark.range(50).select(F.lit(1).cast("long").alias("m"), (F.col("id") * 10).alias("t"), "id", F.lit(1.5).alias("amount"), F.lit("a.b `c`").alias("low"))
    p = Primitive("count_category", "time", -1, "low", "a.b `c`")
    got = event_features(tx, tx.select("m", "t", "id"), [p], hot_rows=10, slice_rows=20)
    (name,) = [c for c in got.columns if c != "id"]
    assert [r[1] for r in got.orderBy("id").collect()] == [float(i) for i in range(50)] and name == p.name


def test_slices_repeat_few_rows(spark):
    """Many slices for short windows; a transaction is in two of them at most, an event in one."""
    tx = spark.range(20_000).select(F.lit(1).cast("long").alias("m"), (F.col("id") * HOUR).alias("t"), "id", F.lit(1.0).alias("amount"), F.lit("a").alias("status"))
    ps = [Primitive("max", "time", 20 * HOUR), Primitive("mean", "row", 10)]
    frame = union_frame(tx, tx.select("m", "t", "id"))
    cut = sliced(frame, ps, {}, 1000, 500)
    per = {(r["__slice"], r.is_tx): r.n for r in cut.groupBy("__slice", "is_tx").agg(F.count("*").alias("n")).collect()}
    assert len(per) == 160 and max(per.values()) < 600 and sum(n for (_, is_tx), n in per.items() if not is_tx) == 20_000
    assert sum(n for (_, is_tx), n in per.items() if is_tx) < 30_000
    assert sliced(frame, ps, {}, 1_000_000, 500) is None


def test_nothing_at_or_after_the_event_matters(spark, random_rows):
    tx, ev = random_rows
    ev = [e for e in ev if e[0] == 1][:6]
    ps = [Primitive("std", "row", 4), Primitive("max", "days", 2), Primitive("total_amount", "time", DAY)]
    first = event_features(*frames(spark, tx, ev), ps).orderBy("id").collect()
    late = max(e[1] for e in ev)
    more = tx + [(1, t, 1000 + i, 999.0, "a") for i, t in enumerate((late, late + 1, late + DAY))]
    assert event_features(*frames(spark, more, ev), ps).orderBy("id").collect() == first


def test_one_exchange_serves_all_orderings(spark, random_rows):
    ps = [Primitive("mean", "time", DAY), Primitive("max", "row", 5), Primitive("avg_daily_count", "days", 7)]
    plan = event_features(*frames(spark, *random_rows), ps)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_transactions_leave_out_equal_times(spark):
    tx, _ = frames(spark, [(1, 5, 1, 10.0, "a"), (1, 5, 2, 20.0, "a"), (1, 6, 3, 30.0, "a")], [(1, 0, 0)])
    p = Primitive("total_amount", "row", 2)
    assert values(transaction_features(tx, [p]), p.name) == [0.0, 0.0, 30.0]


def test_windows_are_checked():
    for bad in (("row", 0), ("days", -1), ("time", -2), ("week", 1), ("row", True)):
        with pytest.raises(ValueError):
            Primitive("mean", *bad)
    with pytest.raises(ValueError):
        value_column(Primitive("median", "row", 3))
    assert Primitive("mean", "time", DAY).name == "feat_mean_amount_time_1d"
    assert Primitive("total_amount", "time", -1).name == "feat_total_amount_amount_time_total"
    assert Primitive("count_category", "row", 5, "status", 0).name == "feat_count_category_status_0_amount_row_5"


def test_rolling_ties_are_inside(spark):
    df = spark.createDataFrame([(1, 1000, 1, 1.0), (1, 1000, 2, 2.0), (1, 2000, 3, 4.0)], "m long, t long, id long, v double")
    count = df.select("id", sliding_window(df, "m", "t", "id", None, "count", "time", 1000).alias("n"))
    assert values(count, "n") == [0.0, 1.0, 2.0]
    total = df.select("id", sliding_window(df, "m", "t", "id", "v", "sum", "rows", 1).alias("n"))
    assert values(total, "n") == [None, 1.0, 2.0]
    for bad in (("median", "rows", 1), ("sum", "days", 1), ("sum", "rows", 0)):
        with pytest.raises(ValueError):
            sliding_window(df, "m", "t", "id", "v", *bad)


def test_scalar_rules(spark):
    df = spark.createDataFrame([(1.0, 0.0), (1.0, None), (None, 2.0), (3.0, 2.0), (2e4, 1e3), (-2e4, 1e3)], "a double, b double")
    a, b = F.col("a"), F.col("b")
    got = df.select(safe_ratio(a, b), clipped_product(a, b), signed_log(a), rate(a, b)).collect()
    assert [r[0] for r in got] == [1.0, 1.0, None, 1.5, 20.0, -20.0]
    assert [r[1] for r in got] == [0.0, None, None, 6.0, 1e6, -1e6]
    assert got[3][2] == pytest.approx(math.log(4)) and got[5][2] == pytest.approx(-math.log(20001))
    assert [r[3] for r in got] == [0.0, 0.0, None, 1.5, 20.0, -20.0]


CODES = [["a", "b"], [], [], [], []]


def test_expressions_compile_and_travel(spark, random_rows):
    tx, ev = frames(spark, *random_rows)
    tree = ex.Log(ex.Sub(ex.SafeDiv(ex.MeanAmount(17), ex.CountTotal(8)), ex.CategoryRate(0, 1, 8)))
    assert ex.from_document(ex.to_document(tree)) == tree
    assert ex.depth(tree) == 4 and ex.count_nodes(tree) == 6
    assert len(ex.dependencies([tree, tree], CODES)) == 3
    got = ex.feature_frame(tx, ev, [tree, ex.CountTotal(8)], CODES).orderBy("id").collect()
    for e, r in zip(random_rows[1], got, strict=True):
        n = naive(random_rows[0], e, Primitive("count_total", "time", -1))
        mean = naive(random_rows[0], e, Primitive("mean", "time", -1))
        b = naive(random_rows[0], e, Primitive("count_category", "time", -1, "status", "b"))
        x = (1.0 if n == 0 else mean / n) - (b / n if n else 0.0)
        assert r.x0 == pytest.approx(math.copysign(math.log1p(abs(x)), x), rel=1e-5, abs=1e-6) and r.x1 == n


@pytest.mark.parametrize("bad", [{"type": "Eval", "fields": {}}, {"type": "Log", "fields": {"value": 3}}, {"type": "MeanAmount", "fields": {"window_i": True}},
                                 {"type": "MeanAmount", "fields": {}}, {"type": "Add", "fields": {"left": 1, "right": 2}}, [], {"type": "MeanAmount"}])
def test_documents_are_checked(bad):
    with pytest.raises(ValueError):
        ex.from_document(bad)


def test_enumeration():
    trees = list(ex.enumerate_trees([["a"], [], [], [], []], 2))
    assert len(trees) == len({ex.key(t) for t in trees}) == sum(ex.tree_count([["a"], [], [], [], []], 2))
    assert [ex.depth(t) for t in trees] == sorted(ex.depth(t) for t in trees)
    assert len(list(ex.terminal_space(CODES))) == 90 + 33 * 2


@pytest.mark.parametrize("kind", ["double", "decimal(18,6)", "float"])
def test_amounts_are_not_rounded(spark, kind):
    amounts = [0.004, 0.004, 1.005, 2.123456, 0.000321]
    tx = spark.createDataFrame([(1, 10 * i, i, a, "a") for i, a in enumerate(amounts)], TX).withColumn("amount", F.col("amount").cast(kind))
    ev = spark.createDataFrame([(1, 25, 0), (1, 45, 1)], "m long, t long, id long")
    ps = [Primitive(k, "time", 1000) for k in ("total_amount", "mean", "max", "std")] + [Primitive("total_amount", "row", 2)]
    got = event_features(tx, ev, ps).orderBy("id").collect()
    rel = 1e-6 if kind == "float" else 1e-12
    for r, x in zip(got, (amounts[:3], amounts), strict=True):
        mean = sum(x) / len(x)
        assert r[ps[0].name] == pytest.approx(sum(x), rel=rel) and r[ps[1].name] == pytest.approx(mean, rel=rel) and r[ps[2].name] == pytest.approx(max(x), rel=rel)
        assert r[ps[3].name] == pytest.approx(math.sqrt(sum((v - mean) ** 2 for v in x) / len(x)), rel=1e-6)
        assert r[ps[4].name] == pytest.approx(sum(x[-2:]), rel=rel)


def test_inputs_with_code_columns_without_times_or_families(spark):
    tx = spark.createDataFrame([(1, i, float(i), i % 2) for i in range(1, 7)], "m long, id long, amount double, status_code int")
    ev = spark.createDataFrame([(1, 4, "x"), (1, 9, "y")], "m long, id long, note string")
    coded, plain = Primitive("count_category", "row", 3, "status", 1), Primitive("count_category", "row", 3)
    got = event_features(tx, ev, [coded, plain], keep=["note"]).orderBy("id").collect()
    assert [(r.note, r[coded.name], r[plain.name]) for r in got] == [("x", 2.0, 3.0), ("y", 1.0, 3.0)]
    with pytest.raises(ValueError, match="card_brand"):
        event_features(tx, ev, [Primitive("count_category", "row", 3, "card_brand", 1)])


def test_trailing_window_objects(spark):
    from lagweave.functions.windows import TRAILING, Trailing
    from lagweave.operators.rolling import aggregate

    df = spark.createDataFrame([(1, 1000, 1, 1.0), (1, 1000, 2, 2.0), (1, 2000, 3, 4.0)], "m long, t long, id long, v double")
    for window, want in ((Trailing(rows=1), [None, 1.0, 2.0]), (Trailing(micros=1000), [None, 1.0, 3.0]), (Trailing(), [None, 1.0, 3.0])):
        assert values(df.select("id", aggregate(df, "m", "t", "id", "v", "sum", window).alias("n")), "n") == want
    assert [Trailing(rows=5).name, Trailing(micros=DAY).name, Trailing(micros=HOUR).name, Trailing(micros=7).name, Trailing().name] == ["last_5_rows", "last_1d", "last_1h", "last_7us", "all_history"]
    assert len(TRAILING) == len({w.name for w in TRAILING}) == 18
    for bad in ({"rows": 0}, {"micros": -1}, {"rows": 1, "micros": 1}, {"rows": True}):
        with pytest.raises(ValueError):
            Trailing(**bad)
    with pytest.raises(TypeError):
        aggregate(df, "m", "t", "id", "v", "sum", 5)
