"""Random forests on bounded bootstraps, a tree to a task.

``pyspark.ml`` grows all trees together: each level passes every row through every tree, and a
row carries its draws for all of them.  Where a tree's bootstrap is bounded, the draws of all
trees are few however large the table is.  They are sent to the trees, binned to a byte a
feature, and each tree then grows alone, level by level, on exact counts of its rows.

The method is that of ``pyspark.ml``: Poisson bootstraps, at most ``BINS`` bins a feature,
Gini impurity, a random subset of features for each node, and the mean of the leaves' class
shares; leaves that would decide alike are not merged, so shares stay as fine as the tree.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BINS = 32
POINTS = 1000  # of a chunk, for the cuts
CHUNK = 1 << 18  # rows that are drawn from at a time
SENT = 4 << 20  # bytes of draws in an Arrow batch
TREES_A_TASK = 8

# a leaf leads to itself
NODE = np.dtype([("feature", "<i4"), ("bin", "u1"), ("left", "<i4"), ("value", "<f8")])


@dataclass(frozen=True)
class SampledForest:
    cuts: list[np.ndarray]
    nodes: list[bytes]
    shares: np.ndarray  # of each tree's gain by feature


def cuts_between(values: np.ndarray, counts: np.ndarray, bins: int = BINS) -> np.ndarray:
    """At most ``bins`` - 1 cuts halfway between neighbours: all of them, or those nearest to equal shares."""
    distinct, at = np.unique(values, return_inverse=True)
    upto = np.zeros(len(distinct), "i8")
    np.add.at(upto, at, counts)
    upto = upto.cumsum()
    between = distinct[:-1] / 2 + distinct[1:] / 2
    known = np.isfinite(between)
    between, below = between[known], upto[:-1][known]
    if len(between) < bins:
        return between
    wanted = upto[-1] * np.arange(1, bins) / bins
    return between[np.unique(np.abs(below - wanted[:, None]).argmin(axis=1))]


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= CHUNK:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def _summing(features: int):
    """Values and counts, times ``POINTS``, of a chunk: all, or those in the middle of ``POINTS`` equal shares."""
    def run(batches):
        for rows in _chunks(batches):
            out = {"feature": [], "x": [], "n": []}
            for i in range(features):
                column = np.sort(rows.column(i).to_numpy())
                x, n = np.unique(column, return_counts=True)
                n = n * POINTS
                if len(x) > POINTS:
                    x, n = column[(2 * np.arange(POINTS) + 1) * len(column) // (2 * POINTS)], np.full(POINTS, len(column))
                out["feature"].append(i)
                out["x"].append(x.astype("f8").tobytes())
                out["n"].append(n.astype("i8").tobytes())
            yield pa.RecordBatch.from_pydict(out, pa.schema([("feature", pa.int32()), ("x", pa.binary()), ("n", pa.binary())]))
    return run


def _cutting(key, table):
    x, n = (np.frombuffer(b"".join(table.column(c).to_pylist()), t) for c, t in (("x", "f8"), ("n", "i8")))
    return pa.table({"feature": pa.array([key[0].as_py()], pa.int32()), "cuts": pa.array([cuts_between(x, n).tolist()], pa.list_(pa.float64()))})


def binned(batch: pa.RecordBatch | pa.Table, cuts: list[np.ndarray]) -> np.ndarray:
    """(rows, features): the number of cuts below each value."""
    return np.column_stack([np.searchsorted(c, batch.column(i).to_numpy(zero_copy_only=False)).astype("u1") for i, c in enumerate(cuts)])


def _drawing(cuts: list[np.ndarray], share: float, trees: int, seed: int):
    """Poisson draws of each row: their sum is a Poisson number, and they fall on rows evenly.  A drawn row has the
    label in its first feature's highest bit."""
    def run(batches):
        rng = np.random.default_rng([seed, 0, TaskContext.get().partitionId()])
        for chunk in _chunks(batches):
            rows = binned(chunk, cuts)
            rows[:, 0] |= chunk.column(len(cuts)).to_numpy().astype("u1") << 7
            whole = rows.view(f"V{rows.shape[1]}").ravel()
            ids, drawn, size = [], [], 0
            for tree in range(trees):
                own = whole.take(rng.integers(0, len(whole), rng.poisson(share * len(whole)))).tobytes()
                ids.append(tree)
                drawn.append(own)
                size += len(own)
                if size >= SENT or tree == trees - 1:
                    yield pa.RecordBatch.from_pydict({"tree": pa.array(ids, pa.int32()), "rows": pa.array(drawn, pa.binary())})
                    ids, drawn, size = [], [], 0
    return run


def _purity(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Weight less Gini impurity times weight."""
    return (zeros * zeros + ones * ones) / np.maximum(zeros + ones, 1e-300)


def grow(rows: np.ndarray, labels: np.ndarray, weights: tuple[float, float], depth: int, leaf: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Nodes by level, and the gain of each feature.  ``rows``: (rows, features) of bins; a side of a split has
    ``leaf`` rows at least."""
    n, features = rows.shape
    subset = math.ceil(math.sqrt(features))
    bins = int(rows.max(initial=0)) + 1
    code = (rows.T + bins * labels.astype("i8")).astype("i8")  # class, then bin
    at, n_nodes, first, levels, gained = np.zeros(n, "i8"), 1, 0, [], np.zeros(features)
    for level in range(depth + 1):
        base = at * (2 * bins)
        counts = np.stack([np.bincount(base + c, minlength=n_nodes * 2 * bins).reshape(n_nodes, 2, bins) for c in code])
        total = counts[0].sum(axis=2)
        zeros, ones = total[:, 0] * weights[0], total[:, 1] * weights[1]
        nodes = np.zeros(n_nodes, NODE)
        nodes["bin"], nodes["left"] = 255, first + np.arange(n_nodes)
        nodes["value"] = np.where(zeros + ones > 0, ones / np.maximum(zeros + ones, 1e-300), 0.5)
        levels.append(nodes)
        if level == depth or bins == 1:
            break
        left = counts.cumsum(axis=3)[..., :-1]
        size = left.sum(axis=2)
        l0, l1 = left[:, :, 0] * weights[0], left[:, :, 1] * weights[1]
        gain = _purity(l0, l1) + _purity(zeros[:, None] - l0, ones[:, None] - l1) - _purity(zeros, ones)[:, None]
        tried = rng.random((n_nodes, features)).argsort(axis=1).argsort(axis=1) < subset
        gain[(size < leaf) | (total.sum(axis=1)[:, None] - size < leaf) | ~tried.T[:, :, None]] = -1.0
        gain = gain.transpose(1, 0, 2).reshape(n_nodes, -1)
        best = gain.argmax(axis=1)
        most = gain[np.arange(n_nodes), best]
        split = most > 1e-12 * (zeros + ones)
        if not split.any():
            break
        by, cut = best // (bins - 1), best % (bins - 1)
        np.add.at(gained, by[split], most[split])
        child = 2 * (np.cumsum(split) - 1)
        first += n_nodes
        nodes["feature"][split], nodes["bin"][split], nodes["left"][split] = by[split], cut[split], first + child[split]
        if not split.all():
            kept = split[at]
            at, code = at[kept], code[:, kept]
        value = code[by[at], np.arange(len(at))]
        at, n_nodes = child[at] + (value - bins * (value >= bins) > cut[at]), 2 * int(split.sum())
    return np.concatenate(levels), gained


def _growing(features: int, weights: tuple[float, float], depth: int, leaf: int, seed: int):
    def run(key, table):
        tree = key[0].as_py()
        rows = np.frombuffer(b"".join(table.column("rows").to_pylist()), "u1").reshape(-1, features).copy()
        labels = rows[:, 0] >> 7
        rows[:, 0] &= 127
        nodes, gained = grow(rows, labels, weights, depth, leaf, np.random.default_rng([seed, 1, tree]))
        return pa.table({"tree": pa.array([tree], pa.int32()), "nodes": pa.array([nodes.tobytes()], pa.binary()), "gained": pa.array([gained.tolist()], pa.list_(pa.float64()))})
    return run


def fit(train: DataFrame, features: list[str], label: str, trees: int, depth: int, leaf: int, most_rows: int, seed: int) -> SampledForest:
    """``train`` has features without nulls; a tree's bootstrap has ``most_rows`` rows on average, or as many
    as there are.  Classes weigh alike."""
    data = train.select(*(F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(features)), F.col(label).cast("double").alias("y"))
    seen = data.agg(F.count("*").alias("n"), F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") == 0).alias("neg")).first()
    if seen.n != seen.pos + seen.neg:
        raise ValueError("labels must be 0 or 1")
    if not seen.pos or not seen.neg:
        raise ValueError("both classes are needed to fit a model")
    summed = data.drop("y").mapInArrow(_summing(len(features)), "feature int, x binary, n binary")
    cuts = [np.array(r.cuts) for r in sorted(summed.groupBy("feature").applyInArrow(_cutting, "feature int, cuts array<double>").collect())]
    weights = (seen.n / (2 * seen.neg), seen.n / (2 * seen.pos))
    drawn = data.mapInArrow(_drawing(cuts, min(1.0, most_rows / seen.n), trees, seed), "tree int, rows binary")
    dealt = drawn.repartition(-(-trees // TREES_A_TASK), "tree")
    grown = dealt.groupBy("tree").applyInArrow(_growing(len(features), weights, depth, leaf, seed), "tree int, nodes binary, gained array<double>").collect()
    grown.sort(key=lambda r: r.tree)
    gains = np.array([r.gained for r in grown])
    return SampledForest(cuts, [bytes(r.nodes) for r in grown], gains / np.maximum(gains.sum(axis=1, keepdims=True), 1e-300))


def scores(rows: np.ndarray, trees: list[np.ndarray]) -> np.ndarray:
    """Mean share of class 1 in the leaves that binned rows reach."""
    n, features = rows.shape
    flat, base, total = rows.ravel(), np.arange(n) * features, np.zeros(n)
    for nodes in trees:
        feature, cut, left = nodes["feature"].astype("i8"), nodes["bin"].copy(), nodes["left"].astype("i8")
        at, before = np.zeros(n, "i8"), None
        while before is None or (at != before).any():
            before = at
            at = left.take(at) + (flat.take(base + feature.take(at)) > cut.take(at))
        total += nodes["value"].take(at)
    return total / len(trees)


def scored(model: SampledForest, df: DataFrame, features: list[str], label: str) -> DataFrame:
    """(label, score) of every row."""
    held = df.sparkSession.sparkContext.broadcast((model.cuts, model.nodes))  # 2 ** (depth + 1) nodes a tree at most

    def run(batches):
        cuts, nodes = held.value
        trees = [np.frombuffer(x, NODE) for x in nodes]
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_pydict({"label": batch.column(len(cuts)), "score": scores(binned(batch, cuts), trees)})
    data = df.select(*(F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(features)), F.col(label).cast("double").alias("y"))
    return data.mapInArrow(run, "label double, score double")
