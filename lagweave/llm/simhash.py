"""SimHash near-duplicates by bit-sliced comparison.

Fingerprint: text lower-cased in A-Z, words split at ASCII white space, shingles of ``n``
words (fewer words: all of them; none: fingerprint 0), XXH64 with seed 42 of each, repeats
included; a bit is 1 if set in over half of the hashes.  Fingerprints link at ``RADIUS`` or
fewer differing bits.

Only distinct fingerprints are compared.  Cut into RADIUS + g parts, two linked fingerprints
agree in g parts at least, so there is one table per choice of g parts and only fingerprints
with one key in one table meet.  g grows with the number of distinct fingerprints until keys
are rare; every g finds every link.  In a bucket, bit planes are stored vertically, 64
fingerprints to a word; each query adds the differing bits of 64 neighbours at a time into a
carry-save counter and drops a word once all its lanes are beyond the radius.  Large buckets
are cut into tiles by hash and compared tile against tile in different tasks.  A tile pair
gives a spanning forest of its links, never all pairs; components are then found on edges.

Defined cases: null and blank texts have fingerprint 0 and are linked like any other; null
ids keep their row, with the least id of the component that is not null; repeated rows share
a fingerprint; a very long text is read whole; an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

import math
import tempfile
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import cut, few, shuffle_count

RADIUS = 4
SEED = 42
TILE = 4096
BUCKET = 1024  # mean number of distinct fingerprints a key may have before g grows
ROOM = 64 << 20  # bytes of shingle sets that a task holds in memory
STEP = 8  # planes between two looks at which words can be dropped


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 of every shingle in order, repeats included; none without a word."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.zeros(0, "<u8")
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    n = min(shingle, len(words))
    starts = (ends - lengths)[: len(words) - n + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[n - 1 :].tolist(), strict=True)], "<u8")


def majority(hashes: np.ndarray, widen=lambda x: x[:, None], words: int = 1) -> np.ndarray:
    """Bits set in over half of the hashes, packed into ``words`` 64-bit words; ``widen`` turns
    a part of the hashes into rows of that many words.  Bytes of 0 or 1 are added eight to a
    word, 255 rows at a time, which no byte overruns."""
    ones = np.zeros(64 * words, np.int64)
    for at in range(0, len(hashes), 255 * 16):
        part = np.ascontiguousarray(widen(hashes[at : at + 255 * 16]))
        bits = np.unpackbits(part.view(np.uint8), axis=1, bitorder="little").view("<u8")
        sums = np.add.reduceat(bits, np.arange(0, len(bits), 255), axis=0)
        ones += sums.view(np.uint8).sum(0, dtype=np.int64)
    return np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")


def fingerprint(text: str | None, shingle: int) -> int:
    """The fingerprint as a signed 64-bit integer."""
    hashes = shingle_hashes(text, shingle)
    return int(majority(hashes).view("<i8")[0]) if len(hashes) else 0


_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprints(docs: DataFrame, id_col="doc_id", text_col="text", shingle: int = 4) -> DataFrame:
    """(doc_id, fp): one row per document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [fingerprint(t.as_py(), shingle) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.int64())], ["doc_id", "fp"])

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return picked.mapInArrow(run, "doc_id long, fp long")


def tables(distinct: int, radius: int = RADIUS) -> list[list[int]]:
    """Masks: one list of bit positions per table."""
    for extra in range(1, 5):
        parts = [list(range(64 * i // (radius + extra), 64 * (i + 1) // (radius + extra))) for i in range(radius + extra)]
        chosen = [[b for p in c for b in p] for c in combinations(parts, extra)]
        if distinct <= BUCKET * 2 ** min(map(len, chosen)):
            return chosen
    return chosen


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


class Forest:
    """Labels under which linked positions are joined; the label is the least position.

    ``by`` has, for each position that is not its own label, one of the given pairs; these
    pairs are a spanning forest."""

    def __init__(self, n: int):
        self.label = np.arange(n)
        self.by = np.zeros((n, 2), np.int64)

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        while True:
            a, b = self.label[i], self.label[j]
            apart = a != b
            if not apart.any():
                return
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            high, low = np.maximum(a, b), np.minimum(a, b)
            np.minimum.at(self.label, high, low)
            least = self.label[high] == low
            self.by[high[least]] = np.stack([i[least], j[least]], 1)
            while not np.array_equal(jumped := self.label[self.label], self.label):
                self.label = jumped


def sliced_links(fps: np.ndarray, group: np.ndarray, radius: int = RADIUS, room: int = 1 << 16) -> np.ndarray:
    """Labels of ``fps`` (uint64, one or more columns, sorted by ``group``) joined where two of
    a group are linked."""
    return sliced_forest(fps, group, radius, room).label


def sliced_forest(fps: np.ndarray, group: np.ndarray, radius: int = RADIUS, room: int = 1 << 16) -> Forest:
    """The forest of the links of ``sliced_links``.

    First all of a group meet its first member.  Only those it does not link are queries after
    that, each against those after it and all linked ones, so a tight group costs one pass."""
    forest = Forest(len(fps))
    if not len(fps):
        return forest
    wide = fps.reshape(len(fps), -1)
    begins = np.diff(group, prepend=group[:1] - 1) != 0
    first = np.flatnonzero(begins)
    sizes = np.diff(first, append=len(group))
    for i, j in _compare(wide, group, begins, radius, room):
        forest.join(i, j)
    linked = forest.label == forest.label[np.repeat(first, sizes)]
    left = np.add.reduceat(~linked, first)
    again = np.flatnonzero(np.repeat((left > 0) & (sizes > 2), sizes))
    if len(again):
        order = again[np.lexsort((linked[again], group[again]))]
        for i, j in _compare(wide[order], group[order], ~linked[order], radius, room):
            forest.join(order[i], order[j])
    return forest


def pairs_between(fps: np.ndarray, group: np.ndarray, label: np.ndarray, radius: int, room: int = 1 << 16) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of one group within ``radius`` whose labels differ, each once; the members of a
    group's largest label are not compared among themselves."""
    first = np.flatnonzero(np.diff(group, prepend=group[:1] - 1))
    sizes = np.diff(first, append=len(group))
    count = np.bincount(label, minlength=len(label))[label]
    most = np.repeat(np.maximum.reduceat(count, first), sizes)
    main = np.minimum.reduceat(np.where(count == most, label, len(label)), first)
    other = label != np.repeat(main, sizes)
    mixed = np.flatnonzero(np.repeat(np.add.reduceat(other, first) > 0, sizes))
    order = mixed[np.lexsort((~other[mixed], group[mixed]))]
    for i, j in _compare(fps.reshape(len(fps), -1)[order], group[order], other[order], radius, room) if len(order) else ():
        i, j = order[i], order[j]
        apart = label[i] != label[j]
        yield i[apart], j[apart]


def _compare(fps: np.ndarray, group: np.ndarray, asks: np.ndarray, radius: int, room: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Each row that ``asks``, with the linked rows after it in its group.

    Rows lie side by side, 64 to a word, so a word may hold many small groups.  A unit of work
    is (query, word): 64 distances, counted in carry-save planes with a sticky overflow, of
    which only lanes of the query's group are alive."""
    n_words, n_bits = (len(fps) + 63) // 64, 64 * fps.shape[1]
    planes = np.empty((n_bits, n_words), np.uint64)
    padded = np.zeros(n_words * 64, np.uint64)
    for b in range(n_bits):
        if b % 64 == 0:
            padded[: len(fps)] = fps[:, b // 64]
        planes[b] = np.packbits((padded >> np.uint64(b % 64)).astype(np.uint8) & 1, bitorder="little").view("<u8")
    ends = np.append(np.flatnonzero(np.diff(group)) + 1, len(group))
    end = np.repeat(ends, np.diff(ends, prepend=0))
    start = np.arange(1, len(fps) + 1)  # a query meets the rows after it
    many = np.where(asks & (start < end), (end - 1) // 64 - start // 64 + 1, 0)
    upto = np.cumsum(many)
    low = 0
    while low < len(fps):
        high = max(low + 1, int(np.searchsorted(upto, (upto[low - 1] if low else 0) + room, "right")))
        query = np.repeat(np.arange(low, high), many[low:high])
        begun = np.repeat(upto[low:high] - many[low:high], many[low:high])
        word = start[query] // 64 + np.arange(upto[low - 1] if low else 0, upto[high - 1]) - begun
        alive = _lanes_from(start[query] - 64 * word) & ~_lanes_from(end[query] - 64 * word)
        counter = [np.zeros(len(query), np.uint64) for _ in range(int(radius).bit_length())]
        keep = np.flatnonzero(alive)
        query, word, alive, counter = query[keep], word[keep], alive[keep], [c[keep] for c in counter]
        for b in range(n_bits if len(query) else 0):
            flip = np.uint64(0) - ((fps[query, b // 64] >> np.uint64(b % 64)) & np.uint64(1))
            carry = planes[b][word] ^ flip
            for k in range(len(counter)):
                counter[k], carry = counter[k] ^ carry, counter[k] & carry
            alive &= ~carry  # the counter ran over
            if b % STEP == STEP - 1:
                alive &= ~_beyond(counter, radius)
                keep = np.flatnonzero(alive)
                if len(keep) < len(alive):
                    query, word, alive, counter = query[keep], word[keep], alive[keep], [c[keep] for c in counter]
                if not len(keep):
                    break
        for at in range(0, len(query), 1 << 12):
            bits = np.unpackbits(alive[at : at + (1 << 12)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            r, lane = np.nonzero(bits)
            yield query[at + r], word[at + r] * 64 + lane
        low = high


def _lanes_from(at: np.ndarray) -> np.ndarray:
    """Words whose lanes from ``at`` on are set: all up to 0, none from 64."""
    ones = np.uint64(0xFFFFFFFFFFFFFFFF) << np.clip(at, 0, 63).astype(np.uint64)
    return np.where(at < 64, ones, np.uint64(0))


def _beyond(counter: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose count is above the radius, looked at from the highest plane down."""
    over, same = np.zeros_like(counter[0]), np.full_like(counter[0], np.uint64(0xFFFFFFFFFFFFFFFF))
    for k in reversed(range(len(counter))):
        if radius >> k & 1:
            same &= counter[k]
        else:
            over |= same & counter[k]
            same &= ~counter[k]
    return over


def _edges(radius: int, outer: int | None):
    """Rows (bucket, tile, tile, node[, fp]) to edges (bucket, a, b, u, v) of nodes; with
    ``outer`` each edge is a pair within ``radius``, and the nodes of pairs that ``outer`` holds
    and links leave apart come as (bucket, a, b, u, null).  Without ``fp`` a node is its own
    fingerprint."""
    def flush(keys, nodes, fps, *_):
        group = _numbers(keys)
        met = np.bincount(group)[group] > 1
        keys, nodes, fps = keys[met], nodes[met], fps[met]
        if not len(nodes):
            return
        group = _numbers(keys)
        forest = sliced_forest(fps, group, radius)
        label = forest.label
        moved = np.flatnonzero(label != np.arange(len(fps)))
        ends = forest.by[moved] if outer else np.stack([moved, label[moved]], 1)
        yield _batch(*(pa.array(keys[moved, c]) for c in range(3)), pa.array(nodes[ends[:, 0]]), pa.array(nodes[ends[:, 1]]))
        if outer:
            open_ = np.zeros(len(nodes), bool)
            for i, j in pairs_between(fps, group, label, outer):
                open_[i] = open_[j] = True
            at = np.flatnonzero(open_)
            yield _batch(*(pa.array(keys[at, c]) for c in range(3)), pa.array(nodes[at]), pa.nulls(len(at), pa.int64()))

    return lambda batches: _runs(batches, flush)


def _batch(*columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns), ["bucket", "a", "b", "u", "v"])


def proven_edges(radius: int | None, outer: int, similarity: float):
    """Rows (bucket, tile, tile, node, fp, hashes, root) to edges (u, v): pairs between the radii
    are compared by their sets of hashes, unless links of the run or a common root join them
    already.  Without ``radius`` all pairs within ``outer`` are."""
    def flush(keys, nodes, fps, sets, roots):
        group = _numbers(keys)
        forest = Forest(len(nodes))
        if radius is not None:
            forest.label = sliced_links(fps, group, radius)
        order = np.lexsort((roots, group))
        same = (group[order][1:] == group[order][:-1]) & (roots[order][1:] == roots[order][:-1])
        forest.join(order[1:][same], order[:-1][same])
        for i, j in pairs_between(fps, group, forest.label.copy(), outer):
            for x, y in zip(i.tolist(), j.tolist(), strict=True):
                if forest.label[x] == forest.label[y]:
                    continue
                left, right = sets[x].load(), sets[y].load()
                both = len(left) + len(right)
                same = len(np.intersect1d(left, right, assume_unique=True))
                if same / max(both - same, 1) >= similarity:
                    low, high = sorted((forest.label[x], forest.label[y]))
                    begin, end = np.searchsorted(group, [group[x], group[x] + 1])
                    part = forest.label[begin:end]
                    part[part == high] = low
        moved = np.flatnonzero(forest.label != np.arange(len(nodes)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(nodes[forest.label[moved]])], ["u", "v"])

    return lambda batches: _runs(batches, flush)


class Held:
    """An array in memory, or in the task's spool file."""

    __slots__ = ("array", "file", "at", "n")

    def __init__(self, array: np.ndarray, file=None):
        self.array, self.file, self.n = array, file, len(array)
        if file is not None:
            self.at = file.seek(0, 2)
            file.write(array.tobytes())
            self.array = None

    def load(self) -> np.ndarray:
        if self.array is not None:
            return self.array
        self.file.seek(self.at)
        return np.frombuffer(self.file.read(8 * self.n), np.int64)


def _runs(batches: Iterator[pa.RecordBatch], flush) -> Iterator[pa.RecordBatch]:
    """Whole runs of equal (bucket, tile, tile) for ``flush``: about 16,384 rows or 16 MB.  A
    run may be larger; its sets beyond ``ROOM`` bytes then wait in a file of the task."""
    held: list[tuple] = []
    size = in_memory = 0
    spool = tempfile.TemporaryFile()
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([np.asarray(batch.column(c)) for c in range(3)], 1)
        nodes = np.asarray(batch.column(3))
        fps = nodes.view(np.uint64)[:, None] if batch.num_columns == 4 else np.frombuffer(b"".join(batch.column(4).to_pylist()), "<u8").reshape(len(nodes), -1)
        sets = np.empty(len(nodes), object)
        if batch.num_columns > 5:
            for k, x in enumerate(batch.column(5)):
                sets[k] = Held(np.array(x.values), spool if in_memory > ROOM else None)
                in_memory += 8 * sets[k].n if sets[k].array is not None else 0
        roots = np.asarray(batch.column(6)) if batch.num_columns > 6 else nodes
        held.append((keys, nodes, fps, sets, roots))
        size += max(batch.nbytes, batch.num_rows << 10)
        if size < 1 << 24:
            continue
        keys, nodes, fps, sets, roots = (np.concatenate(x) for x in zip(*held, strict=True))
        ends = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
        stop = int(ends[-1]) if len(ends) else 0  # the last group may go on in the next batch
        if stop:
            yield from flush(keys[:stop], nodes[:stop], fps[:stop], sets[:stop], roots[:stop])
        held, size = [(keys[stop:], nodes[stop:], fps[stop:], sets[stop:], roots[stop:])], 0
        in_memory = sum(8 * x.n for x in sets[stop:] if x is not None and x.array is not None)
        if stop == len(keys):
            spool.truncate(0)
    if held:
        yield from flush(*(np.concatenate(x) for x in zip(*held, strict=True)))


def _numbers(keys: np.ndarray) -> np.ndarray:
    return np.cumsum(np.r_[0, (keys[1:] != keys[:-1]).any(1).astype(np.int64)])


def bucket_edges(keyed: DataFrame, radius: int, outer: int | None = None, sizes: DataFrame | None = None) -> DataFrame:
    """(bucket, node[, fp]) rows to edges (u, v) that span the links of each bucket; see ``_edges``.
    ``sizes`` (bucket, n), if known, has the rows of each bucket.

    A large bucket is dealt to its pairs of tiles; others have one tile."""
    rest = [c for c in keyed.columns if c not in ("bucket", "node")]
    sizes = keyed.groupBy("bucket").agg(F.count("*").alias("n")) if sizes is None else sizes
    large = cut(sizes.filter(F.col("n") > TILE).select("bucket", F.ceil(F.col("n") / TILE).cast("int").alias("tiles")), "simhash-large")
    tiled = keyed.join(large, "bucket", "left").withColumn("tile", F.pmod(F.xxhash64("node", "bucket"), F.coalesce("tiles", F.lit(1))).cast("int"))
    others = F.sequence(F.lit(0), F.coalesce("tiles", F.lit(1)) - 1)
    dealt = tiled.select("bucket", "node", *rest, "tile", F.explode(others).alias("other")).select(
        "bucket", F.least("tile", "other").cast("long").alias("a"), F.greatest("tile", "other").cast("long").alias("b"), "node", *rest)
    parts = max(shuffle_count(keyed.sparkSession), 1)
    ordered = dealt.repartition(parts, "bucket", "a", "b").sortWithinPartitions("bucket", "a", "b", "node")
    return ordered.mapInArrow(_edges(radius, outer), "bucket long, a long, b long, u long, v long")


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (u, v) between distinct fingerprints (column ``fp``) whose closure is that of all links."""
    masks = tables(fps.count(), radius)
    keys: list[Column] = [F.struct(F.lit(t).cast("long").alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(sum(1 << b for b in m)))).alias("key")) for t, m in enumerate(masks)]
    keyed = fps.select(F.col("fp").alias("node"), F.explode(F.array(*keys)).alias("k"))
    return bucket_edges(keyed.select("node", F.xxhash64("k.t", "k.key").alias("bucket")), radius).select("u", "v")


def near_groups(docs: DataFrame, id_col="doc_id", text_col="text", shingle: int = 4, radius: int = RADIUS) -> DataFrame:
    """One row per document: doc_id, fp (long), component_id."""
    slim = cut(fingerprints(docs, id_col, text_col, shingle), "simhash")
    files = few(slim.count())
    nodes = cut(slim.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "simhash-nodes", files)
    roots = components(links(nodes.select("fp"), radius), few((radius + 1) * nodes.count()))
    named = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
    first = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
    # written: the joins after it meet keys with very many rows, which AQE splits only between plain exchanges
    first = cut(first, "simhash-first", files)
    named = cut(named.join(first, "root").select("fp", "component_id"), "simhash-named", files)
    return slim.join(named, "fp").select("doc_id", "fp", "component_id").coalesce(files)
