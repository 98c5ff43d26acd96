"""Near-duplicates on word shingles by wide SimHash fingerprints, compared bit-sliced.

64 bits and a radius of four (``simhash``) hold copies of nearly equal texts only: texts that
share 0.8 of their five-word shingles differ in ten of 64 bits.  Here a fingerprint has
``BITS`` bits and two radii, ``MARGIN`` standard deviations below and ``REACH`` above the
distance expected at the wanted similarity.  Texts with one set of shingles are one node.  Pairs within
the inner radius give a forest for each bucket, and every edge of it is compared by its sets of
shingles.  Pairs between the two are compared so in the bucket's task, unless edges there join
them already; beyond a pair is not linked.  Where an edge fails, all pairs of its bucket within
the outer radius are compared.  No pair leaves a task unless it is an edge of a forest.

Which fingerprints meet is decided by ``bands``: each is a hash of ``ROWS`` minima of the
shingles' hashes, so texts that share 0.8 of them agree in one band at least with a
probability of 0.999.  Buckets of one node are left out before fingerprints move.  The others
are compared by carry-save counters in ``simhash``, large ones in tiles, and give a spanning
forest of links.  Sets of shingles then move only for tiles that proven links have not joined
already; components are found on edges.

Defined cases: null and blank texts have the empty set and are linked; texts of fewer words
than a shingle are one shingle; rows without an id are in no group and stay; rows that share
an id stay or go together; a very long text is shingled whole, and its set waits in a file of
its task where there is no room; an empty table gives an empty result; further columns are
kept, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import cut, shuffle_count
from .simhash import bucket_edges, majority, proven_edges, shingle_hashes

BITS = 1024
ROWS = 5
MARGIN = 3.0
REACH = 4.5
MISS = 0.001
SHINGLE = 5
SIMILARITY = 0.8
CHUNK = 4080  # shingles whose minima are taken at a time

_draw = np.random.Generator(np.random.PCG64(42))
_SALT = _draw.integers(0, 1 << 64, BITS // 64, dtype=np.uint64)
_ODD = _draw.integers(0, 1 << 64, 4096, dtype=np.uint64) | np.uint64(1)
_SHIFT = _draw.integers(0, 1 << 64, 4096, dtype=np.uint64)


def radii(similarity: float, bits: int = BITS) -> tuple[int, int]:
    """Two sets of one size and Jaccard similarity s have a cosine of 2s / (1 + s)."""
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    off = math.sqrt(bits * share * (1 - share))
    return max(math.floor(bits * share - MARGIN * off), 0), math.ceil(bits * share + REACH * off)


def bands_for(similarity: float) -> int:
    """Bands of which texts of that similarity share none with a probability of ``MISS``."""
    if similarity >= 1:
        return 1
    return min(math.ceil(math.log(MISS) / math.log(1 - similarity**ROWS)), len(_ODD) // ROWS)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def signature(text: str | None, shingle: int, bands: int) -> tuple[bytes, bytes, np.ndarray]:
    """A digest of the set of shingles, the fingerprint's bytes and the bands as signed 64-bit
    integers."""
    hashes = np.unique(shingle_hashes(text, shingle))  # the radii are those of sets
    digest = hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()
    if not len(hashes):
        return digest, bytes(BITS // 8), np.zeros(bands, np.int64)
    fp = majority(hashes, lambda x: _mix(x[:, None] ^ _SALT[None, :]), len(_SALT))
    n = bands * ROWS
    least = np.full(n, np.uint64(0xFFFFFFFFFFFFFFFF))
    for at in range(0, len(hashes), CHUNK):
        part = hashes[at : at + CHUNK]
        np.minimum(least, (part[None, :] * _ODD[:n, None] + _SHIFT[:n, None]).min(1), out=least)
    keys = np.zeros(bands, np.uint64)
    for column in least.reshape(bands, ROWS).T:
        keys = _mix(keys ^ column)
    return digest, fp.tobytes(), keys.view(np.int64)


def similar_groups(docs: DataFrame, id_col="doc_id", text_col="text", shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, component_id): one row per document that has an id."""
    bands = bands_for(similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 1000):
                part = batch.slice(low, 1000)
                made = [signature(t.as_py(), shingle, bands) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([m[0] for m in made], pa.binary()), pa.array([m[1] for m in made], pa.binary()),
                                                  pa.array([m[2] for m in made], pa.list_(pa.int64()))], ["doc_id", "digest", "fp", "bands"])

    picked = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    slim = cut(picked.mapInArrow(run, "doc_id long, digest binary, fp binary, bands array<long>"), "similar")
    nodes = cut(slim.groupBy("digest").agg(F.min("doc_id").alias("node"), F.min_by("fp", "doc_id").alias("fp"), F.min_by("bands", "doc_id").alias("bands")), "similar-nodes")
    # buckets of a single node, nearly all, are left out before any fingerprint moves
    thin = nodes.select("node", F.posexplode("bands")).select("node", F.xxhash64("pos", "col").alias("bucket"))
    sizes = cut(thin.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1"), "similar-buckets")
    met = cut(thin.join(sizes.select("bucket"), "bucket"), "similar-met")
    inner, outer = radii(similarity)
    found = cut(bucket_edges(met.join(nodes.select("node", "fp"), "node").select("node", "fp", "bucket"), inner, outer, sizes), "similar-edges")
    edges = found.filter("v is not null").select("bucket", "a", "b", F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    pairs = cut(edges.select("u", "v").distinct(), "similar-pairs")
    sets = cut(_sets(picked, found.select(F.explode(F.array("u", "v")).alias("node")).filter("node is not null"), shingle), "similar-sets")
    checked = cut(_compared(pairs, sets, similarity), "similar-checked")
    failed = checked.filter("not same").select(F.col("u").alias("fu"), F.col("v").alias("fv"))
    bad = cut(edges.join(failed, (F.col("u") == F.col("fu")) & (F.col("v") == F.col("fv"))).select("bucket", "a", "b").distinct(), "similar-bad")
    again = found.join(bad, ["bucket", "a", "b"], "left_semi").select("bucket", "a", "b", F.explode(F.array("u", "v")).alias("node")).filter("node is not null").distinct()
    unsure = found.filter("v is null").join(bad, ["bucket", "a", "b"], "left_anti").select("bucket", "a", "b", F.col("u").alias("node"))

    # nodes that proven links join already need no comparison: a tile goes on only if it meets two groups
    links = checked.filter("same").select("u", "v")
    known = cut(components(links).select(F.col("node").alias("at"), "root"), "similar-known")

    def proven(rows: DataFrame, radius: int | None) -> DataFrame:
        rooted = cut(rows.join(known, rows["node"] == known["at"], "left").select(*rows.columns, F.coalesce("root", "node").alias("root")), "similar-rooted")
        mixed = cut(rooted.groupBy("bucket", "a", "b").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low != high").select("bucket", "a", "b"), "similar-mixed")
        left = rooted.join(mixed, ["bucket", "a", "b"], "left_semi")
        full = left.join(nodes.select("node", "fp"), "node").join(sets, "node").select("bucket", "a", "b", "node", "fp", "hashes", "root")
        parts = shuffle_count(docs.sparkSession)
        return full.repartition(parts, "bucket", "a", "b").sortWithinPartitions("bucket", "a", "b", "node").mapInArrow(
            proven_edges(radius, outer, similarity), "u long, v long")

    roots = components(links.unionByName(proven(unsure, inner)).unionByName(proven(again, None)))
    # written: the join after it meets digests with very many rows, which AQE splits only between plain exchanges
    named = cut(nodes.join(roots.withColumnRenamed("node", "__at"), F.col("node") == F.col("__at"), "left").select(
        "digest", F.coalesce("root", "node").alias("component_id")), "similar-named")
    return slim.select("doc_id", "digest").join(named, "digest").select("doc_id", "component_id")


def _compared(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(u, v, same): whether the sets of u and v are as similar as wanted."""
    one = pairs.join(sets.select(F.col("node").alias("u"), F.col("hashes").alias("x")), "u")
    both = one.join(sets.select(F.col("node").alias("v"), F.col("hashes").alias("y")), "v")
    common = both.select("u", "v", (F.size("x") + F.size("y")).alias("n"), F.size(F.array_intersect("x", "y")).alias("k"))
    return common.select("u", "v", (F.col("k") / F.greatest(F.col("n") - F.col("k"), F.lit(1)) >= similarity).alias("same"))


def _sets(picked: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """(node, hashes): the sets of shingle hashes of the nodes wanted."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 500):
                part = batch.slice(low, 500)
                sets = [np.unique(shingle_hashes(t.as_py(), shingle)).view(np.int64) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int64()))], ["node", "hashes"])

    ids = cut(wanted.select(F.col("node").alias("__at")).distinct(), "similar-wanted")
    return picked.join(ids, picked["doc_id"] == ids["__at"], "left_semi").mapInArrow(run, "node long, hashes array<long>")


def keep_representatives(docs: DataFrame, id_col="doc_id", **options) -> DataFrame:
    """One document of each group, that with the least id; the columns of ``docs``.

    The ids that go are written first: their measured size decides whether texts stay where
    they are (broadcast) or are joined by a shuffle."""
    gone = similar_groups(docs, id_col=id_col, **options).filter("doc_id != component_id").select(F.col("doc_id").alias("__near_id")).distinct()
    gone = cut(gone, "similar-gone")
    return docs.join(gone, docs[id_col] == gone["__near_id"], "left_anti")
