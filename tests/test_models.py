"""Folds, stumps, ranks, archives and runs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lagweave.catalog import inputs
from lagweave.operators import bagging, forest, selection
from lagweave.operators import evaluation as ev
from lagweave.operators import statistics as st
from lagweave.operators.prefix import running_max, running_sums
from lagweave.plans import expressions as ex
from lagweave.plans.archive import ActiveSet, Archive, Member, front
from lagweave.plans.scoring import Evaluator, MaterializationError, batch_gains
from lagweave.plans.search import Search
from lagweave.plans.strategies import Genetic, random_tree, subtrees
from lagweave.plans.tracking import RunCatalog


def test_fold_bounds():
    assert ev.fold_bounds(12) == [(3, 6), (6, 9), (9, 12)]
    assert ev.fold_bounds(14) == [(5, 8), (8, 11), (11, 14)]
    with pytest.raises(ValueError):
        ev.fold_bounds(3)
    with pytest.raises(ValueError):
        ev.fold_bounds(9, 1)


def test_equal_times_share_a_group(spark):
    df = spark.createDataFrame([(i, (i // 2) * 10**11, i % 2) for i in range(16)], "id long, t long, label int")
    assert [r.grp for r in ev.time_groups(df).orderBy("id").collect()] == [i // 2 for i in range(16)]
    folds = ev.assign_folds(df)
    both = folds.groupBy("fold", "t").agg(F.count_distinct("role").alias("n")).filter("n > 1")
    assert both.count() == 0


@pytest.mark.parametrize("rows", [10, 1000])
def test_running_sums_do_not_depend_on_ranges(spark, rows):
    rng = random.Random(2)
    xs = rng.sample(range(10**6), 500)
    df = spark.createDataFrame([(float(x), i) for i, x in enumerate(xs)], "x double, n long")
    got = {r.x: r.n_upto for r in running_sums(df, "x", ["n"], rows_a_range=rows).collect()}
    total = 0
    for x, n in sorted((float(x), i) for i, x in enumerate(xs)):
        total += n
        assert got[x] == total


def brute_stump(rows, leaf):
    xs = sorted({x for x, _, _ in rows})
    best = None
    for a, b in zip(xs, xs[1:]):
        left, right = [r for r in rows if r[0] <= a], [r for r in rows if r[0] > a]
        if min(len(left), len(right)) < leaf:
            continue
        score = sum((sum(w * y for _, w, y in side)) ** 2 / sum(w for _, w, _ in side) for side in (left, right))
        if best is None or score > best[0] + 1e-9:
            best = (score, (a + b) / 2, *(sum(w * y for _, w, y in side) / sum(w for _, w, _ in side) for side in (left, right)))
    return best


def test_stump_equals_brute_force(spark):
    rng = random.Random(6)
    rows = [(float(rng.randrange(40)), rng.random() + 0.1, rng.gauss(0, 1)) for _ in range(300)]
    df = spark.createDataFrame(rows, "x double, w double, r double")
    got, want = ev.best_split(df, "x", "w", "r", 20), brute_stump(rows, 20)
    assert got["threshold"] == want[1] and got["left"] == pytest.approx(want[2]) and got["right"] == pytest.approx(want[3])
    assert ev.best_split(df, "x", "w", "r", 151) is None


def test_batch_scores_equal_single_scores(spark):
    rng = random.Random(3)
    df = spark.createDataFrame([(i, i * 10**11, rng.randrange(2), float(rng.randrange(30)), None if rng.random() < 0.2 else rng.random(), 1.0) for i in range(400)], "id long, t long, label int, a double, b double, c double")
    folds = ev.assign_folds(df).persist()
    based = folds.join(ev.fold_baselines(folds).select("fold", F.col("intercept").alias("at")), "fold")
    got = {(r.cand, r.fold): r.gain for r in batch_gains(based, ["a", "b", "c"], F.col("at"), leaf=20).collect()}
    for i, c in enumerate("abc"):
        assert [got[i, k] for k in range(3)] == pytest.approx(ev.residual_gains(folds, c, leaf=20))
    assert [got[2, k] for k in range(3)] == [0.0, 0.0, 0.0]


def test_auc_and_spearman(spark):
    rng = random.Random(4)
    rows = [(rng.randrange(2), float(rng.randrange(12)), rng.random(), 3.0) for _ in range(200)]
    df = spark.createDataFrame(rows, "label int, x double, y double, z double")
    pos, neg = [r[1] for r in rows if r[0]], [r[1] for r in rows if not r[0]]
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / len(pos) / len(neg)
    assert ev.roc_auc(df, "label", "x").first().auc == pytest.approx(want)
    got = {(r.left, r.right): r.rho for r in ev.spearman_pairs(df, ["x", "y", "z"]).collect()}
    assert got["x", "x"] == pytest.approx(1) and got["x", "z"] is None and got["x", "y"] == pytest.approx(got["y", "x"])


def test_fold_spread_known_values(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0, 3.0), (2, 1.0, 1.0, None), (3, 2.0, None, None)], "g int, a double, b double, c double")
    got = [r.fold_sd for r in st.row_spread(df, ["a", "b", "c"]).orderBy("g").collect()]
    assert got[0] == pytest.approx(0.816497, abs=1e-6) and got[1:] == [0.0, None]


def test_holm_and_tails(spark):
    df = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03)], "k string, p double")
    assert {r.k: round(r.adjusted, 6) for r in st.holm(df, "p", "k").collect()} == {"a": 0.03, "b": 0.06, "c": 0.06}
    assert st.chi2_tail(3.841459, 1) == pytest.approx(0.05, abs=1e-6) and st.chi2_tail(5.991465, 2) == pytest.approx(0.05, abs=1e-6)
    assert st.normal_tail(1.959964) == pytest.approx(0.025, abs=1e-6)


def test_pareto_front(spark):
    rng = random.Random(5)
    rows = [(i, *(float(rng.randrange(6)) for _ in range(4))) for i in range(80)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, d double")
    vectors = [list(r[1:]) for r in rows]
    got = {r.id for r in selection.pareto_front(df, ["a", "b", "c", "d"], [True, True, True, False]).collect()}
    assert got == set(front(vectors))


@pytest.mark.parametrize("block", [7, 60])
def test_pareto_front_in_blocks(spark, block):
    rng = random.Random(15)
    rows = [(i, rng.random(), rng.random(), float(rng.randrange(9))) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double")
    got = {r.id for r in selection.pareto_front(df, ["a", "b", "c"], [True, True, False], block).collect()}
    assert got == set(front([list(r[1:]) for r in rows], (True, True, False)))
    line = df.withColumn("b", -F.col("a"))  # all of it is front
    assert selection.pareto_front(line, ["a", "b"], [True, True], block).count() == 300


@pytest.mark.parametrize("rows", [10, 1000])
def test_running_max_and_sweep(spark, rows):
    rng = random.Random(16)
    data = [(float(x), rng.random()) for x in rng.sample(range(10**6), 400)]
    df = spark.createDataFrame(data, "x double, y double")
    got = {r.x: r.before for r in running_max(df, "x", "y", "before", rows_a_range=rows).collect()}
    top, kept = None, []
    for x, y in sorted(data):
        assert got[x] == top
        if top is None or y > top:
            kept.append(x)
        top = y if top is None else max(top, y)
    assert sorted(r.x for r in selection.sweep_front(df, "x", "y").collect()) == kept


def test_presence_counts(spark):
    texts = ["(feat_mean_amount_time_1d + feat_max_amount_row_5)", "signed_log((feat_count_total_amount_time_1d - feat_category_rate_status_0_amount_time_1d))", "(feat_avg_daily_count_amount_days_7 / feat_total_amount_amount_row_5)"]
    df = spark.createDataFrame([(t,) for t in texts], "e string")
    assert {r.name: r.n for r in st.presence_counts(df, "e").collect()} == {"Amount aggregate": 2, "Count aggregate": 1, "Daily aggregate": 1, "Category rate": 1, "Addition (+)": 1, "Subtraction (-)": 1,
                                                                         "Safe division (/)": 1, "Signed log": 1}


def leaf(i):
    return ex.MeanAmount(i)


def test_archive_never_evicts_and_travels():
    a = Archive()
    assert len(a.admit([Member(leaf(0), [0.1, 0.1, 0.1, 1.0]), Member(leaf(1), [0.0, 0.0, 0.0, 2.0])])) == 1
    assert len(a.admit([Member(leaf(2), [0.2, 0.2, 0.2, 1.0]), Member(leaf(0), [9.0, 9.0, 9.0, 1.0]), Member(leaf(3), [float("nan")] * 4)])) == 1
    assert [m.expr for m in a.members] == [leaf(0), leaf(2)]
    doc = a.to_document({"status": {"x": 0}})
    assert [m.objectives for m in Archive.from_document(doc, {"status": {"x": 0}}).members] == [m.objectives for m in a.members]
    with pytest.raises(ValueError):
        Archive.from_document(doc, {"status": {"y": 0}})


class Signals:
    """An evaluator with given signals and gains."""

    def __init__(self, spark, signals, gains):
        self.spark, self.by, self.gains, self.active, self.version = spark, signals, gains, [], 0

    def signals(self, trees):
        rows = [(i, *(float(self.by[e.window_i][i]) for e in trees)) for i in range(len(next(iter(self.by.values()))))]
        return self.spark.createDataFrame(rows, ["id", *(f"x{i}" for i in range(len(trees)))])

    def evaluate(self, trees):
        return [self.gains[self.version].get(e.window_i, [-1.0] * 3 + [1.0]) for e in trees]

    def activate(self, e):
        self.active.append(e)
        self.version += 1


def test_history_and_promotion(spark):
    signals = {0: [1, 2, 3, 4.5], 1: [1, 2, 3, 4], 2: [1, -1, 1, -1], 3: [5, 5, 5, 5], 4: [2, 1, 4, 3]}
    gains = {0: {0: [0.01, 0.01, 0.01, 1.0], 2: [0.02, 0.02, 0.02, 1.0]}, 1: {0: [0.01, 0.0, 0.0, 1.0]}, 2: {}}
    s = ActiveSet(Signals(spark, signals, gains))
    got = s.admit([Member(leaf(0), [0.5, 0.1, 0.5, 1.0]), Member(leaf(1), [0.1, 0.5, 0.1, 1.1]), Member(leaf(2), [0.2, 0.2, 0.6, 0.8]), Member(leaf(3), [0.3, 0.3, 0.3, 0.7]), Member(leaf(4), [0.0, 0.9, 0.9, 0.1])])
    assert sorted(got.values()) == ["admitted", "admitted", "peer_correlation", "quality_threshold", "signal_constant"]
    assert s.promote(3) == [] and s.promote(0) == []
    promoted = s.promote(5)
    assert [m.expr.window_i for m in promoted] == [2, 0] and s.evaluator.version == 2
    assert s.promote(10) == []
    assert s.to_document()["active_size"] == 2


def test_genetic_operators_keep_depth():
    rng = random.Random(0)
    leaves = [leaf(i) for i in range(5)]
    g = Genetic([["a"], [], [], [], []], max_depth=3, size=30)
    members = [Member(random_tree(rng, leaves, 3), [rng.random() for _ in range(4)]) for _ in range(20)]
    made = g.generate(members, 4)
    assert len(made) == 30 and all(ex.depth(t) <= 3 for t in made)
    assert [ex.key(t) for t in made] == [ex.key(t) for t in g.generate(members, 4)]
    tree = ex.Add(leaf(0), ex.Log(leaf(1)))
    assert len(list(subtrees(tree))) == 4


def test_search_keeps_failures_with_their_candidate(spark):
    d = "/root/testdata/sf0.001"
    evaluator = Evaluator(inputs.event_transactions(spark, d).persist(), inputs.event_spine(spark, d), [["click"], [], [], [], []], leaf=10)
    good, bad = ex.MeanAmount(17), ex.CountCategory(1, 0, 0)
    out = evaluator.evaluate([good, bad])
    assert len(out[0]) == 4 and isinstance(out[1], MaterializationError)
    search = Search.build("gp_active", evaluator, size=4, max_depth=2)
    search.run(generations=2)
    candidates, generations = search.tables(spark)
    assert generations.count() == 2 and candidates.count() == 8
    with pytest.raises(ValueError):
        Search.build("exhaustive", evaluator)


def test_run_catalog(spark, tmp_path):
    c = RunCatalog(tmp_path)
    assert c.search(spark).count() == 0
    a, b = c.create("random", 1, "g1"), c.create("gp_active", 2, "g2", {"size": 3})
    c.move(a, "search_failed", "boom")
    with pytest.raises(ValueError):
        c.move(a, "complete")
    c.move(b, "complete")
    c.log_metrics(b, {"auc": 0.75})
    assert [r.run_id for r in c.search(spark).collect()] == [b, a]
    assert c.search(spark, states=["search_failed"]).first().error == "boom"
    assert c.search(spark, groups=["g2"]).first().metrics == {"auc": 0.75}
    (tmp_path / "note.txt").write_text("x")
    c.upload(b, tmp_path / "note.txt", "note.txt")
    assert c.download(b, "note.txt").read_text() == "x"
    c.delete(a)
    assert c.search(spark).count() == 1


def slow_tree(rows, labels, weights, depth, leaf):
    """The class share at each row of a tree that tries every split of every feature."""
    weight = np.where(labels == 1, weights[1], weights[0])
    pure = lambda m: ((weight[m] * labels[m]).sum() ** 2 + (weight[m] * (1 - labels[m])).sum() ** 2) / weight[m].sum()
    out = np.zeros(len(rows))

    def visit(mask, level):
        out[mask] = (weight[mask] * labels[mask]).sum() / weight[mask].sum()
        best = (1e-9, None)
        for f in range(rows.shape[1]):
            for cut in range(int(rows.max())):
                left, right = mask & (rows[:, f] <= cut), mask & (rows[:, f] > cut)
                if min(left.sum(), right.sum()) >= leaf and (gain := pure(left) + pure(right) - pure(mask)) > best[0] + 1e-9:
                    best = (gain, (left, right))
        if level < depth and best[1]:
            for side in best[1]:
                visit(side, level + 1)
    visit(np.ones(len(rows), bool), 0)
    return out


@pytest.mark.parametrize(("n", "depth", "leaf"), [(1, 3, 2), (40, 1, 2), (300, 4, 7), (300, 10, 2)])
def test_sampled_tree_equals_brute_force(n, depth, leaf):
    rng = np.random.default_rng(3)
    rows = rng.integers(0, 12, (n, 2)).astype("u1")  # of two features both are tried
    labels = ((rows[:, 0] > 5) ^ (rows[:, 1] > 3) ^ (rng.random(n) < 0.2)).astype("u1")
    nodes, gained = bagging.grow(rows, labels, (0.8, 1.3), depth, leaf, rng)
    assert np.allclose(bagging.scores(rows, [nodes]), slow_tree(rows, labels, (0.8, 1.3), depth, leaf))
    assert (gained.sum() > 0) == (n > 1)


def test_cuts():
    assert bagging.cuts_between([3.0, 1.0, 2.0, 1.0], [1, 1, 1, 1]).tolist() == [1.5, 2.5]
    assert bagging.cuts_between([7.0, 7.0], [5, 5]).tolist() == []
    many = bagging.cuts_between(np.arange(1001.0), np.ones(1001, "i8"))
    assert len(many) == bagging.BINS - 1 and np.diff(many).min() >= 31
    assert bagging.cuts_between(np.arange(100.0), [10_000] + [1] * 99)[0] == 0.5


def test_cuts_of_a_table_do_not_depend_on_its_partitions(spark):
    made = spark.range(30_000).select((F.xxhash64("id") % 5000).cast("double").alias("a"), F.when(F.col("id") == 777, 3.0).otherwise(F.col("id") % 3).cast("double").alias("b"),
                                      (F.col("id") % 2).alias("label"))
    for parts in (1, 7):
        df = made.repartition(parts)
        model = bagging.fit(df, ["a", "b"], "label", trees=3, depth=2, leaf=2, most_rows=100, seed=1)
        ranked = np.searchsorted(model.cuts[0], [r.a for r in df.collect()])
        assert model.cuts[1].tolist() == [0.5, 1.5, 2.5] and len(model.shares) == 3
        assert len(model.cuts[0]) == 31 and np.bincount(ranked).min() > 850 and np.bincount(ranked).max() < 1030


def _labelled(spark, n):
    x = F.xxhash64("id") % 1000 / 1000
    return spark.range(n, numPartitions=3).select("id", x.alias("a"), F.when(F.col("id") % 7 > 0, F.xxhash64("id", F.lit(1)) % 50).cast("double").alias("b"),
                                                  (x + F.xxhash64("id", F.lit(2)) % 100 / 300 > 0.2).cast("int").alias("label"))


def test_bounded_forest_reads_its_rows_no_more_often_for_deeper_trees(spark):
    df, tracker = _labelled(spark, 3000).persist(), spark.sparkContext.statusTracker()
    jobs, _ = {}, df.count()
    for depth in (2, 9):
        spark.sparkContext.setJobGroup(f"forest {depth}", "")
        model = forest.fit_forest(df, ["a", "b"], trees=30, depth=depth, most_rows=500)
        jobs[depth] = len(tracker.getJobIdsForGroup(f"forest {depth}"))
    spark.sparkContext.setJobGroup("", "")
    assert jobs[2] == jobs[9]
    assert forest.forest_auc(model, df, ["a", "b"]) > 0.95
    shares = {name: mean for name, mean, _ in forest.importances(model, ["a", "b"])}
    assert shares["a"] > 0.6 and sum(shares.values()) == pytest.approx(1)
    df.unpersist()


def test_bounded_forest_agrees_with_the_library(spark):
    df = _labelled(spark, 4000)
    train, test = df.filter("id % 3 > 0").persist(), df.filter("id % 3 = 0").persist()
    bounded = forest.forest_auc(forest.fit_forest(train, ["a", "b"], trees=60, depth=6, leaf=2, most_rows=100_000), test, ["a", "b"])
    assert bounded == pytest.approx(forest.forest_auc(forest.fit_forest(train, ["a", "b"], trees=60, depth=6, leaf=2), test, ["a", "b"]), abs=0.01)
    with pytest.raises(ValueError):
        forest.fit_forest(train.filter("label = 1"), ["a"], most_rows=10)


def test_draws_are_bounded_whatever_the_table(spark):
    for n, most, low, high in ((40_000, 1000, 900, 1100), (500, 1000, 400, 600)):
        data = spark.range(n, numPartitions=4).select((F.col("id") % 9).cast("double").alias("x0"), (F.col("id") % 2).cast("double").alias("y"))
        drawn = data.mapInArrow(bagging._drawing([np.array([2.5, 5.5])], min(1.0, most / n), 20, 1), "tree int, rows binary")
        sums = drawn.groupBy("tree").agg(F.sum(F.length("rows")).alias("n")).collect()
        assert len(sums) == 20 and low < sum(r.n for r in sums) / 20 < high
