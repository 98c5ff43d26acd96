"""Scores of a whole generation of candidates in one job.

The features of all candidates come from one pass over the union frame.  Rows are then laid
out by (candidate, fold, value), added up, and every stump is found by windows per candidate
and fold, so tasks share the work by candidate; the best splits, one row per candidate and
fold, are joined back by broadcast to predict the validation rows."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import newton_response, newton_weight, sigmoid
from ..operators import evaluation as ev
from ..operators.asof import event_features
from .cache import FeatureCache
from .expressions import CodeLists, Expr, count_nodes, feature_frame

FOLDS = 3
RANGES = 32  # most ranges that the values of a candidate and fold are cut into
ROWS_A_RANGE = 500_000
MAXIMIZE = (True, True, True, False)


class MaterializationError(ValueError):
    """A candidate that cannot be computed."""


class NumericalFitnessError(ValueError):
    """A candidate whose score is not finite."""


def cost(e: Expr, codes: CodeLists) -> float:
    """A deterministic stand-in for seconds: primitives weigh by their windows' cost."""
    weight = {"row": 2.0, "time": 1.5, "days": 2.5}
    return sum((2.0 if p.kind in ("max", "std") else 1.0) * weight[p.window_type] for p in {p.name: p for p in e.primitives(codes)}.values()) + 0.1 * count_nodes(e)


def _points(byx: DataFrame, ranges: int) -> DataFrame:
    """Rows (cand, fold, x, n, w, s) with the sums up to x (nl, wl, sl), in all (all_n, all_w, all_s) and the
    next value (nx) of the candidate and fold."""
    if ranges <= 1:
        key = Window.partitionBy("cand", "fold")
        upto = key.orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
        return byx.withColumns({**{f"{c}l": F.sum(c).over(upto) for c in "nws"}, "nx": F.lead("x").over(key.orderBy("x")), **{f"all_{c}": F.sum(c).over(key) for c in "nws"}})
    cuts = byx.groupBy("cand", "fold").agg(F.percentile_approx("x", [i / ranges for i in range(1, ranges)], 10_000).alias("cuts"))
    # a row for each candidate and fold, then for each of their ranges
    parted = byx.join(F.broadcast(cuts), ["cand", "fold"]).withColumn("range", F.size(F.filter("cuts", lambda c: c < F.col("x")))).drop("cuts")
    totals = parted.groupBy("cand", "fold", "range").agg(*(F.sum(c).alias(f"own_{c}") for c in "nws"), F.min("x").alias("least"))
    key = Window.partitionBy("cand", "fold")
    before = key.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("cand", "fold", "range", *(F.coalesce(F.sum(f"own_{c}").over(before), F.lit(0)).alias(f"{c}b") for c in "nws"), *(F.sum(f"own_{c}").over(key).alias(f"all_{c}") for c in "nws"),
                            F.lead("least").over(key.orderBy("range")).alias("then"))
    inside = Window.partitionBy("cand", "fold", "range").orderBy("x")
    joined = parted.join(F.broadcast(offsets), ["cand", "fold", "range"])
    return joined.withColumns({**{f"{c}l": F.sum(c).over(inside.rowsBetween(Window.unboundedPreceding, 0)) + F.col(f"{c}b") for c in "nws"}, "nx": F.coalesce(F.lead("x").over(inside), F.col("then"))})


def batch_gains(assigned: DataFrame, columns: list[str], at: Column, label: str = "label", leaf: int = ev.LEAF, ranges: int = 1) -> DataFrame:
    """(cand, fold, gain) for columns of ``assigned`` (rows with fold and role); ``at`` is the
    logit that each stump is added to.  The values of a candidate and fold are cut into
    ``ranges``, each a task's work; any number of them gives the same gains."""
    pairs = F.explode(F.array(*(F.struct(F.lit(i).alias("cand"), F.coalesce(F.col(c), F.lit(0.0)).cast("float").cast("double").alias("x")) for i, c in enumerate(columns))))
    y, p = F.col(label).cast("double"), sigmoid(F.col("at"))
    rows = assigned.select("fold", "role", y.alias("y"), at.alias("at"), pairs.alias("c")).select("fold", "role", "y", "at", "c.*").withColumn("p", p)
    train = rows.filter("role = 'train'").withColumn("w", newton_weight(F.col("p"))).withColumn("r", newton_response(F.col("y"), F.col("p")))
    byx = train.groupBy("cand", "fold", "x").agg(F.count("*").alias("n"), F.sum("w").alias("w"), F.sum(F.col("w") * F.col("r")).alias("s"))
    points = _points(byx, ranges)
    left, right = F.col("sl") / F.col("wl"), (F.col("all_s") - F.col("sl")) / (F.col("all_w") - F.col("wl"))
    valid = (F.col("nl") >= leaf) & (F.col("all_n") - F.col("nl") >= leaf)
    gain = F.when(valid, F.col("sl") * left + (F.col("all_s") - F.col("sl")) * right)
    split = F.when(valid, F.struct(F.round(gain, 9).alias("g"), (-F.col("x")).alias("first"), ((F.col("x") + F.col("nx")) / 2).alias("at"), left.alias("l"), right.alias("r")))
    mean, varies = F.first(F.col("all_s") / F.col("all_w")), F.count("*") > 1
    best = points.groupBy("cand", "fold").agg(F.max(split).alias("b"), F.when(varies, mean).otherwise(0.0).alias("mean"))
    joined = rows.filter("role = 'valid'").join(F.broadcast(best), ["cand", "fold"])
    stump = F.when(F.col("b").isNull(), F.col("mean")).when(F.col("x") <= F.col("b.at"), F.col("b.l")).otherwise(F.col("b.r"))
    after = sigmoid(F.col("at") + ev.SHRINKAGE * stump)
    by = joined.groupBy("cand", "fold").agg(ev.brier(F.col("y"), F.col("p")).alias("b0"), ev.brier(F.col("y"), after).alias("b1"))
    return by.select("cand", "fold", ev.relative_improvement(F.col("b1"), F.col("b0")).alias("gain"))


@dataclass
class Evaluator:
    """Scores trees on the training split.  ``active`` trees, in order, are stumps that the
    baseline already has; a new version of them drops the cached baseline."""

    tx: DataFrame
    events: DataFrame
    codes: CodeLists
    folds: int = FOLDS
    leaf: int = ev.LEAF
    active: list[Expr] = field(default_factory=list)
    version: int = 0
    cache: FeatureCache | None = None

    def __post_init__(self):
        train = self.events.filter("split = 'train'")
        if not train.limit(1).count():
            raise ValueError("the training split is empty")
        if train.select("label").distinct().count() < 2:
            raise ValueError("the training split has one class")
        self.spine = ev.assign_folds(train, self.folds).select("id", "fold", "role", "label", "m", "t").persist()
        bases = ev.fold_baselines(self.spine).select("fold", "intercept")
        self.base = self.spine.join(F.broadcast(bases), "fold").withColumn("at", F.col("intercept")).drop("intercept").persist()
        self._scored: tuple[int, DataFrame] = (0, self.base)
        self.ranges = min(RANGES, 1 + self.spine.count() // ROWS_A_RANGE)

    def activate(self, e: Expr) -> None:
        self.active.append(e)
        self.version += 1

    def baseline(self) -> DataFrame:
        """Rows with the logit ``at`` of the current version; computed once per version."""
        version, df = self._scored
        while version < self.version:
            e = self.active[version]
            x = feature_frame(self.tx, self._events(), [e], self.codes)
            joined = df.join(x, "id")
            parts = []
            for k in range(self.folds):
                part = joined.filter(F.col("fold") == k).withColumn("__p", sigmoid(F.col("at")))
                part = part.withColumn("__w", newton_weight(F.col("__p"))).withColumn("__r", newton_response(F.col("label").cast("double"), F.col("__p")))
                stump, _ = ev.fit_stump(part.filter("role = 'train'"), "x0", "__w", "__r", self.leaf)
                parts.append(part.withColumn("at", F.col("at") + ev.SHRINKAGE * stump).select(df.columns))
            before, df = df, parts[0]
            for part in parts[1:]:
                df = df.unionByName(part)
            df = df.persist()
            df.count()
            if before is not self.base:
                before.unpersist()
            version += 1
            self._scored = (version, df)
        return df

    def close(self) -> None:
        """Release what is held in memory; the evaluator can be used on, but starts over."""
        for df in (self._scored[1], self.base, self.spine):
            df.unpersist()

    def _events(self) -> DataFrame:
        return self.events.filter("split = 'train'").select("id", "m", "t")

    def signals(self, trees: list[Expr]) -> DataFrame:
        """id and x0, x1, ...: the features on the training split."""
        return feature_frame(self.tx, self._events(), trees, self.codes, source=self.cache.features if self.cache else event_features)

    def score_folds(self, rows: DataFrame, names: list[str]) -> DataFrame:
        """(cand, fold, gain) of the columns ``names``; subclasses score by another model."""
        return batch_gains(rows, names, F.col("at"), leaf=self.leaf, ranges=self.ranges)

    def evaluate(self, trees: list[Expr]) -> list[list[float] | Exception]:
        """[fold gains..., cost] per tree.  A batch that fails is tried tree by tree, so that a
        failure stays with its candidate."""
        if not trees:
            return []
        try:
            return self._batch(trees)
        except Exception as error:  # noqa: BLE001
            if len(trees) == 1:
                return [MaterializationError(str(error))]
            return [r for e in trees for r in self.evaluate([e])]

    def _batch(self, trees):
        names = [f"x{i}" for i in range(len(trees))]
        rows = self.baseline().join(self.signals(trees), "id").persist()
        got: dict[int, dict[int, float]] = {}
        try:
            for r in self.score_folds(rows, names).collect():
                got.setdefault(r.cand, {})[r.fold] = r.gain
        finally:
            rows.unpersist()
        out: list = []
        for i, e in enumerate(trees):
            gains = [got.get(i, {}).get(k) for k in range(self.folds)]
            bad = any(g is None or g != g or abs(g) == float("inf") for g in gains)
            out.append(NumericalFitnessError("a fold has no finite score") if bad else [*gains, cost(e, self.codes)])
        return out
