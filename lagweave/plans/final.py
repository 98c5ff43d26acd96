"""Final evaluation on the held-out split."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import clip_probability, logit, newton_response, newton_weight, sigmoid
from ..operators import evaluation as ev
from ..operators import forest
from .expressions import CodeLists, Expr, feature_frame, key


def unique(trees: list[Expr]) -> list[Expr]:
    return list({key(e): e for e in trees}.values())


def split_frame(tx: DataFrame, events: DataFrame, trees: list[Expr], codes: CodeLists) -> tuple[DataFrame, list[str]]:
    names = [f"x{i}" for i in range(len(trees))]
    return feature_frame(tx, events, trees, codes, keep=("label", "split")), names


def both_reports(tx: DataFrame, events: DataFrame, trees: list[Expr], codes: CodeLists, n_trees: int = 500, depth: int = 10, leaf: int = ev.LEAF) -> tuple[dict | None, dict]:
    """``forest_report`` and ``additive_report`` from one pass over the transactions."""
    frame = split_frame(tx, events, unique(trees), codes)[0].persist()
    try:
        return forest_report(tx, events, trees, codes, n_trees, depth, frame), additive_report(tx, events, trees, codes, leaf, frame)
    finally:
        frame.unpersist()


def forest_report(tx: DataFrame, events: DataFrame, trees: list[Expr], codes: CodeLists, n_trees: int = 500, depth: int = 10, made: DataFrame | None = None) -> dict | None:
    """AUC of both splits, importances and rank correlations of the features; None without trees.
    ``made`` is the trees' split frame where it is persisted already."""
    trees = unique(trees)
    if not trees:
        return None
    frame, names = split_frame(tx, events, trees, codes)
    frame = frame.persist() if made is None else made
    train, test = frame.filter("split = 'train'"), frame.filter("split = 'test'")
    if not train.limit(1).count() or not test.limit(1).count():
        raise ValueError("a split is empty")
    model = forest.fit_forest(train, names, trees=n_trees, depth=depth, leaf=2, most_rows=100_000)
    filled = frame.fillna(0.0, names)
    report = {"train_auc": forest.forest_auc(model, train, names), "test_auc": forest.forest_auc(model, test, names),
              "importances": forest.importances(model, names), "features": {n: e.text(codes) for n, e in zip(names, trees, strict=True)},
              "spearman": [tuple(r) for r in ev.spearman_pairs(filled, names).collect()]}
    if made is None:
        frame.unpersist()
    return report


def additive_report(tx: DataFrame, events: DataFrame, trees: list[Expr], codes: CodeLists, leaf: int = ev.LEAF, made: DataFrame | None = None) -> dict:
    """Intercept and one shrunken stump per tree, fitted in order on the whole training split."""
    trees = unique(trees)
    frame, names = split_frame(tx, events, trees, codes)
    frame = frame.persist() if made is None else made
    train = frame.filter("split = 'train'")
    at = F.lit(train.agg(logit(clip_probability(F.avg(F.col("label").cast("double"))))).first()[0])
    stumps = []
    for name in names:
        rows = train.withColumn("__p", sigmoid(at)).withColumn("__w", newton_weight(F.col("__p"))).withColumn("__r", newton_response(F.col("label").cast("double"), F.col("__p")))
        stump, described = ev.fit_stump(rows, name, "__w", "__r", leaf)
        at = at + ev.SHRINKAGE * stump
        stumps.append(described)
    scored = frame.withColumn("__score", F.round(at, 10))
    auc = {s: ev.roc_auc(scored.filter(F.col("split") == s), "label", "__score").first()[0] for s in ("train", "test")}
    if made is None:
        frame.unpersist()
    return {"train_auc": auc["train"], "test_auc": auc["test"], "stumps": stumps}
