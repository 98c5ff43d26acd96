"""Connected components by alternating large-star and small-star steps on DataFrames.

Edges stay distributed; each step is one minimum per node and one join.  Minima are written
before the join, so that both sides of it have an exchange that AQE can split when a node
with very many edges appears; large-star also moves edges away from such nodes.  Their
files follow the number of edges, since every round writes four tables.

Defined cases: edges from a node to itself, repeated edges and edges in either direction are
allowed; ends must not be null; no edges give an empty result."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, few, release

MAX_ROUNDS = 60


def _with_minimum(pairs: DataFrame, files: int) -> tuple[DataFrame, DataFrame]:
    """(u, v) with the least of u and its v's as m; and the table that must live until then."""
    least = cut(pairs.groupBy("u").agg(F.min("v").alias("low")).select(F.col("u").alias("w"), F.least("u", "low").alias("m")), "star-min", files)
    return pairs.join(least, pairs["u"] == least["w"]).drop("w"), least


def _large_star(edges: DataFrame, files: int) -> tuple[DataFrame, DataFrame]:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    joined, least = _with_minimum(both, files)
    return joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct(), least


def _small_star(edges: DataFrame, files: int) -> tuple[DataFrame, DataFrame]:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    joined, least = _with_minimum(down, files)
    kept = joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = least.select(F.col("w").alias("u"), F.col("m").alias("v"))
    return kept.unionByName(own).filter("u != v").distinct(), least


def components(edges: DataFrame, files: int | None = None) -> DataFrame:
    """(u, v) edges, longs, to (node, root): root is the least node of the component.  Nodes
    that are their own root are left out.  ``files`` bounds the files of the first table."""
    edges = cut(edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges", files)
    files = few(2 * edges.count())  # a round has each edge in both directions
    seen = None
    for _ in range(MAX_ROUNDS):
        wide, a = _large_star(edges, files)
        wide = cut(wide, "edges", files)
        narrow, b = _small_star(wide, files)
        after = cut(narrow, "edges", files)
        for used in (a, b, wide, edges):
            release(used)
        edges = after
        now = tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u") % 1000003)).first())
        if now == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = now
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
