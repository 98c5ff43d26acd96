"""Run bundles, life cycles, recovery, the feature cache, final tables and comparisons."""

import json
import math
import random
from itertools import combinations, permutations

import pytest
from pyspark.sql import functions as F

from lagweave.functions.windows import DAY, Primitive
from lagweave.operators.asof import event_features
from lagweave.plans import comparison
from lagweave.plans import expressions as ex
from lagweave.plans import report
from lagweave.plans.archive import Archive, Member
from lagweave.plans.bundle import Bundle, Lifecycle, added_keys, open_bundle, shares_members
from lagweave.plans.cache import FeatureCache, event_set_checksum
from lagweave.plans.scoring import batch_gains
from lagweave.plans.search import CANDIDATES, GENERATIONS, Batch
from lagweave.plans.tracking import RunCatalog, RunStateError
from lagweave.operators import evaluation as ev
from lagweave.sources import tables


def member(i, gain=0.1):
    return Member(ex.MeanAmount(i), [gain, gain, gain, 1.0])


def test_bundle_is_seen_whole_or_not_at_all(tmp_path):
    source = tmp_path / "mapping.json"
    source.write_text("{}")
    bundle = Bundle(tmp_path / "runs" / "a", "a", "random")
    (bundle.staging / "archive.json").write_text("[]")
    assert not (tmp_path / "runs" / "a").exists()
    done = bundle.publish({"mapping": str(source)}, {"seed": 1})
    assert open_bundle(done) == done and not list(done.parent.glob(".*"))
    assert json.loads((done / "manifest.json").read_text())["run_id"] == "a"
    with pytest.raises(FileExistsError):
        Bundle(tmp_path / "runs" / "a", "a", "random")
    again = Bundle(tmp_path / "runs" / "a", "a", "random", force=True)
    (again.staging / "archive.json").write_text("[1]")
    again.publish({}, {})
    assert (done / "archive.json").read_text() == "[1]"
    (done / "archive.json").write_text("[2]")
    with pytest.raises(ValueError, match="archive.json"):
        open_bundle(done)


def test_failed_bundle_goes_under_partial(tmp_path):
    bundle, other = (Bundle(tmp_path / n, n, "random") for n in "ab")
    (bundle.staging / "archive.json").write_text("[]")
    (bundle.staging / "candidates.csv").write_text("x")
    kept = bundle.fail(RuntimeError("boom"))
    assert kept == tmp_path / "partial" / "a" and not (tmp_path / "a").exists()
    assert sorted(p.name for p in kept.iterdir()) == ["candidates.csv", "status.json"] and "boom" in (kept / "status.json").read_text()
    with pytest.raises(ValueError):
        open_bundle(kept)
    assert other.staging.exists()
    other.discard()
    assert [p.name for p in tmp_path.iterdir()] == ["partial"]


def test_life_cycle_files_grow_and_archives_do_not_shrink(spark, tmp_path):
    cycle, archive = Lifecycle(tmp_path, {}, CANDIDATES.names, GENERATIONS.names), Archive()
    for g in range(2):
        archive.members.append(member(g))
        cycle.generation(g, [("random", g, g, 'a "quoted", text', "d", 0.1, None, 0.3, 1.0, True, "evaluated", None)], ("random", g, 1, 1, 0, 0, 1, len(archive.members), 1, 0.5, 0.5 + g), archive)
    read = tables.read_csv(spark, tmp_path / "candidates", CANDIDATES).orderBy("Generation").collect()
    assert [(r.Generation, r.Expression, r.Split2, r.ArchiveMember) for r in read] == [(g, 'a "quoted", text', None, True) for g in range(2)]
    assert tables.read_csv(spark, tmp_path / "generations", GENERATIONS).count() == 2
    second = json.loads((tmp_path / "snapshots" / "generation-000001.json").read_text())
    assert second["added"] == [member(1).key]
    archive.members.pop(0)
    with pytest.raises(ValueError, match="lost"):
        cycle.generation(2, [], ("random",) + (0,) * 10, archive)
    assert added_keys({"a"}, {"a", "b"}) == {"b"} and shares_members({"a", "b"}, {"b"}) and not shares_members({"a"}, {"b"})


def test_recovery_needs_the_right_state(tmp_path):
    c = RunCatalog(tmp_path)
    run = c.create("random")
    with pytest.raises(RunStateError, match="search_complete or analysis_failed"):
        c.require(run, ("search_complete", "analysis_failed"), "analyze")
    c.move(run, "search_complete")
    c.require(run, ("search_complete", "analysis_failed"), "analyze")
    c.move(run, "analysis_failed", "boom")
    c.move(run, "complete")
    c.require(run, ("complete",), "report")


def test_unbound_batch(tmp_path, spark):
    seen = []
    codes = [["a"], [], [], [], []]
    cycle = Lifecycle(tmp_path, {}, CANDIDATES.names, GENERATIONS.names)
    batch = Batch(codes, 7, 2, (seen.append,))
    made = batch.run(cycle)
    batch.save(str(tmp_path))
    assert made == seen == list(ex.enumerate_trees(codes, 2))[:7]
    assert [ex.from_document(d) for d in tables.read_json(tmp_path / "expressions.json")] == made
    assert {r.Status for r in tables.read_csv(spark, tmp_path / "candidates", CANDIDATES).collect()} == {"generated"} and not (tmp_path / "snapshots").exists()


def small(spark, n=60):
    rng = random.Random(3)
    tx = spark.createDataFrame([(i % 3, i * 10**9, i, rng.randrange(1, 99) / 8, "ab"[i % 2]) for i in range(n)], "m long, t long, id long, amount double, status string")
    return tx, spark.createDataFrame([(i % 4, i * 7 * 10**9, i, i % 2) for i in range(9)], "m long, t long, id long, label int")


def test_feature_cache(spark, tmp_path, monkeypatch):
    tx, events = small(spark)
    ps = [Primitive("mean", "time", DAY), Primitive("count_category", "row", 4, "status", "a")]
    cache = FeatureCache(tmp_path)
    want = event_features(tx, events, ps, keep=["label"]).orderBy("id").collect()
    assert cache.features(tx, events, ps[:1]).count() == 9
    calls = []
    monkeypatch.setattr("lagweave.plans.cache.event_features", lambda tx, e, p, *a: (calls.append([x.name for x in p]), event_features(tx, e, p, *a))[1])
    got = cache.features(tx, events.repartition(3), ps, keep=["label"])
    assert got.orderBy("id").collect() == want and got.columns == ["id", "label", *(p.name for p in ps)]
    assert calls == [[ps[1].name]]  # the first was known
    assert cache.features(tx, events, ps).count() == 9 and len(calls) == 1
    checksum, rows = event_set_checksum(events)
    assert (checksum, rows) == event_set_checksum(events.orderBy(F.desc("id"))) and checksum != event_set_checksum(events.filter("id > 0"))[0]
    note = cache._note(checksum, ps[0].name)
    note.write_text(json.dumps(json.loads(note.read_text()) | {"duration": -1}))
    assert cache.known(checksum, rows, [p.name for p in ps]) == {ps[1].name} and not cache.known(checksum, rows + 1, [ps[1].name])


@pytest.mark.parametrize("ranges", [2, 7, 32])
def test_gains_do_not_depend_on_ranges(spark, ranges):
    rng = random.Random(5)
    df = spark.createDataFrame([(i, i * 10**11, rng.randrange(2), rng.random(), float(rng.randrange(4)), 1.0) for i in range(400)], "id long, t long, label int, a double, b double, c double")
    folds = ev.assign_folds(df).persist()
    based = folds.join(ev.fold_baselines(folds).select("fold", F.col("intercept").alias("at")), "fold")
    gains = lambda n: {(r.cand, r.fold): r.gain for r in batch_gains(based, ["a", "b", "c"], F.col("at"), leaf=20, ranges=n).collect()}
    assert gains(ranges) == pytest.approx(gains(1))


def test_final_tables(spark, tmp_path):
    members = [member(0), Member(ex.MaxAmount(1), [0.2, float("nan"), 0.2, 2.0])]
    forest = {"importances": [("x0", 0.75, 0.1), ("x1", 0.25, 0.0)], "spearman": [("x0", "x0", 1.0), ("x0", "x1", None)]}
    made = report.final_tables(spark, forest, members, [[]] * 5, 40)
    report.write_final(tmp_path, made, {"test_auc": 0.5})
    back, metrics = report.read_final(spark, tmp_path)
    assert metrics["test_auc"] == 0.5 and [df.count() for df in back.values()] == [2, 2, 2, 2]
    features = back["features"].orderBy(F.desc("search_fold_1")).collect()
    assert features[0].search_fold_2 is None and features[0].feature_label.startswith("feat_max_amount") and len({r.feature_id for r in features}) == 2
    assert {(r.spearman, r.training_row_count) for r in back["correlations"].collect()} == {(1.0, 40), (None, 40)}
    for bad in ({"model": 1.0}, {"auc": float("nan")}):
        with pytest.raises(ValueError):
            report.write_final(tmp_path, made, bad, force=True)
    (tmp_path / "evaluation" / "metrics.json").write_text('{"format": "other"}')
    with pytest.raises(ValueError):
        report.read_final(spark, tmp_path)


def brute_u(a, b):
    return sum((x > y) + 0.5 * (x == y) for x in a for y in b)


def test_pairs_equal_brute_force(spark):
    rng = random.Random(9)
    groups = {g: [float(rng.randrange(20)) + k for _ in range(12)] for k, g in enumerate("abc")}
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("a", None), ("b", float("nan"))]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {(r.left, r.right): r for r in comparison.pair_tests(df, "g", "v").collect()}
    assert set(got) == set(combinations("abc", 2))
    for (a, b), r in got.items():
        assert r.u_statistic == brute_u(groups[a], groups[b]) and (r.n_left, r.n_right) == (12, 12)
        assert r.rank_biserial == pytest.approx(2 * r.u_statistic / 144 - 1) and 0 <= r.p_value <= r.p_adjusted <= 1
    assert comparison.pair_tests(df.filter("g = 'a'"), "g", "v").count() == 0


@pytest.mark.parametrize("n, m", [(1, 1), (2, 3), (3, 4), (4, 4)])
def test_exact_probability_by_counting(n, m):
    us = [sum(x > y for x in p[:n] for y in p[n:]) for p in permutations(range(n + m))]
    for u in range(n * m + 1):
        top = max(u, n * m - u)
        want = min(1.0, 2 * sum(x >= top for x in us) / len(us))
        assert comparison.u_probability(float(u), n, m, 0.0) == pytest.approx(want)


def test_normal_probability():
    # of 20 against 20 without ties, U = 290: mean 200, deviation sqrt(20 * 20 * 41 / 12)
    z = (290 - 200 - 0.5) / math.sqrt(20 * 20 * 41 / 12)
    assert comparison.u_probability(290.0, 20, 20, 0.0) == pytest.approx(math.erfc(z / math.sqrt(2)))
    assert comparison.u_probability(50.0, 10, 10, 20.0**3 - 20) is None


def test_run_rows_and_report(spark, tmp_path):
    for g, base in (("gp", 0.7), ("random", 0.5)):
        for seed in range(1, 5):
            folder = tmp_path / g / f"seed_{seed}"
            folder.mkdir(parents=True)
            (folder / "summary.json").write_text(json.dumps({"configuration": {"seed": seed}, "final_metrics": {"test_roc_auc": base + seed / 100}, "counts": {"evaluated": 10}, "objectives": [1, 2],
                                                             "timings": {"search_seconds": 20.0 * seed, "final_evaluation_seconds": 1.0}}))
            (folder / "diagnostics.csv").write_text("Generation,MaterializationTime,Dependencies\n0,1.5,a;b\n3,2.5,b; c\n")
    (tmp_path / "enumerative-60s-summary.json").write_text('{"configuration": {"seed": 7}}')
    (tmp_path / "enumerative-90s-summary.json").write_text("{}")  # without a seed
    rows = comparison.run_rows(spark, tmp_path).orderBy("strategy", "seed").collect()
    assert [(r.strategy, r.seed) for r in rows] == [("enumerative", 7)] + [(g, s) for g in ("gp", "random") for s in range(1, 5)]
    assert (rows[1].score, rows[1].total_seconds, rows[1].seconds_per_candidate, rows[1].generations, rows[1].materialization_seconds, rows[1].dependencies, rows[1].archive_size) == (0.71, 21.0, 2.0, 3.0, 4.0, 3.0, 2.0)
    text = comparison.comparison_report(comparison.run_rows(spark, tmp_path))
    assert "gp against random: n=(4, 4), U=16, p=0.02857, adjusted=0.02857, effect=1" in text and "all values are equal" in text
    with pytest.raises(ValueError):
        comparison.run_rows(spark, tmp_path / "gp" / "seed_1")
