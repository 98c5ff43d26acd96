"""Exact deduplication with counting quotient filters.

Each task builds one filter of its fingerprints for each segment of the 64-bit range.  A
fingerprint's offset in its segment is cut into a quotient of ``q`` bits, chosen for a load of
at most ``LOAD``, and a remainder of ``r``.  Slots hold remainders; a quotient's run of sorted
remainders starts at its home slot or after the run before it, and three bits a slot say
whether the quotient with that number is occupied, whether a run ends there, and whether the
slot is a counter of the remainder before it (only counts above one have a counter).
Filters of a segment, of whatever ``q``, are merged by walking their sorted entries; nothing
is lost, since quotient and remainder give the fingerprint back.  Fingerprints with a count
above one are the candidates: their texts, and no others, are brought together and compared
byte by byte.

Hot groups: a task adds a group's copies up before anything is moved, both in its filter and
when texts are grouped, so a group costs one row per task however many copies it has.

Defined cases: a null text is empty; all blank texts are equal; of equal texts the one with
the most code points stays, then the smallest id (a null id comes last); repeated rows with
one id form a group of which one row stays; a very long text is hashed and compared whole; an
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import SPACE, cut, shuffle_count

LOAD = 0.8
BLOOM_WORDS = 1 << 20  # 64-bit words of the bitmap that keeps unique texts from being moved: 16 MB of rows


def segment_bounds(segment: int, segments: int) -> tuple[int, int]:
    """The first fingerprint of a segment and the bits that an offset in it needs."""
    first, after = (-(-s * (1 << 32) // segments) << 32 for s in (segment, segment + 1))
    return first, max(after - first - 1, 1).bit_length()


def _bits(at: np.ndarray, n: int) -> bytes:
    flags = np.zeros(n, np.uint8)
    flags[at] = 1
    return np.packbits(flags, bitorder="little").tobytes()


def build_segments(fingerprints: np.ndarray, segments: int) -> Iterator[tuple[int, int, int, bytes, bytes, bytes, bytes]]:
    """Filters of the fingerprints (uint64): segment, first fingerprint (signed), bits of a
    remainder, occupied quotients, run ends, counter slots, slots."""
    values, counts = np.unique(fingerprints, return_counts=True)
    parts = ((values >> np.uint64(32)) * np.uint64(segments) >> np.uint64(32)).astype(np.int64)
    edges = np.flatnonzero(np.diff(parts, prepend=-1, append=segments))
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        first, width = segment_bounds(int(parts[a]), segments)
        more = counts[a:b] > 1
        place = np.cumsum(1 + more) - 1 - more  # of each remainder among the entries
        n = (b - a) + int(more.sum())
        q = min(max(math.ceil(math.log2(n / LOAD)), 1), width - 8)
        offsets = values[a:b] - np.uint64(first)
        entries, quotients, counter = np.empty(n, np.uint64), np.empty(n, np.int64), np.ones(n, bool)
        counter[place] = False
        quotients[place] = (offsets >> np.uint64(width - q)).astype(np.int64)
        entries[place] = offsets & np.uint64((1 << (width - q)) - 1)
        quotients[counter], entries[counter] = quotients[place[more]], counts[a:b][more]
        slot = np.maximum.accumulate(quotients - np.arange(n)) + np.arange(n)
        size = int(slot[-1]) + 1
        slots = np.zeros((size, 8), np.uint8)
        slots[slot] = entries.astype("<u8").view(np.uint8).reshape(-1, 8)
        ends = slot[np.diff(quotients, append=-1) != 0]
        wide = (max(width - q, int(counts[a:b].max()).bit_length()) + 7) // 8
        yield (int(parts[a]), first - (1 << 64 if first >= 1 << 63 else 0), width - q, _bits(quotients, 1 << q), _bits(ends, size), _bits(slot[counter], size),
               np.ascontiguousarray(slots[:, :wide]).tobytes())


def open_segment(first: int, r: int, occupied: bytes, run_ends: bytes, counters: bytes, slots: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Sorted fingerprints and counts of a filter."""
    flags = lambda raw: np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little")
    quotients, ends = np.flatnonzero(flags(occupied)), np.flatnonzero(flags(run_ends))
    starts = np.maximum(quotients, np.append(-1, ends[:-1]) + 1)
    lengths = ends - starts + 1
    at = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))
    counter = flags(counters)[at].astype(bool)
    wide = len(slots) // (int(ends[-1]) + 1)
    whole = np.zeros((len(at), 8), np.uint8)
    whole[:, :wide] = np.frombuffer(slots, np.uint8).reshape(-1, wide)[at]
    entries = whole.view("<u8").reshape(-1)
    place = np.flatnonzero(~counter)
    values = ((np.repeat(quotients, lengths)[place].astype(np.uint64) << np.uint64(r)) | entries[place]) + np.uint64(first % (1 << 64))
    counts = np.ones(len(at), np.uint64)
    counted = np.flatnonzero(counter)
    counts[counted - 1] = entries[counted]
    return values, counts[place]


def merge_segments(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """One segment of two; both are sorted, so each goes to its place by binary search."""
    values = np.insert(a[0], np.searchsorted(a[0], b[0]), b[0])
    counts = np.insert(a[1], np.searchsorted(a[0], b[0]), b[1])
    first = np.flatnonzero(np.diff(values, prepend=values[:1] ^ np.uint64(1)))
    return values[first], np.add.reduceat(counts, first) if len(first) else counts


FILTER = ["segment", "first", "r", "occupied", "run_ends", "counters", "slots"]
SEGMENT = "segment int, first long, r int, occupied binary, run_ends binary, counters binary, slots binary"


def _filters(segments: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.asarray(b.column(0)).view(np.uint64) for b in batches if b.num_rows]
        if held:
            rows = list(zip(*build_segments(np.concatenate(held), segments), strict=True))
            kinds = (pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 4)
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(rows, kinds, strict=True)], FILTER)
    return run


def _repeated(table: pa.Table) -> pa.Table:
    parts = [open_segment(*x) for x in zip(*(table.column(c).to_pylist() for c in FILTER[1:]), strict=True)]
    while len(parts) > 1:  # pairwise, so each entry is moved log n times
        parts = [merge_segments(*parts[i:i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    values, counts = parts[0]
    more = counts > 1
    return pa.table({"fp": pa.array(values[more].view(np.int64)), "n": pa.array(counts[more].astype(np.int64))})


def repeated_fingerprints(fps: DataFrame) -> DataFrame:
    """Fingerprints (column ``fp``, long) that occur more than once, with their counts."""
    segments = shuffle_count(fps.sparkSession) * 4
    return fps.select("fp").mapInArrow(_filters(segments), SEGMENT).groupBy("segment").applyInArrow(_repeated, "fp long, n long")


def groups(docs: DataFrame, id_col="doc_id", text_col="text", whole_rows: bool = False) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256; with
    ``whole_rows`` also the input row as struct ``row``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    row = [F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")] if whole_rows else []
    plain = docs.select(F.col(id_col).alias("doc_id"), F.regexp_replace(text, SPACE + "+", "").alias("norm"), F.char_length(text).alias("points"), *row)
    slim = cut(plain.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "points", F.xxhash64("norm").alias("fp"), F.sha2("norm", 256).alias("sha"), *(["row"] if row else [])), "exact-slim")
    more = cut(repeated_fingerprints(slim), "exact-repeated")
    # a bitmap of fixed size lets nearly all unique texts stay where they are
    word = F.pmod(F.shiftrightunsigned("fp", 6), F.lit(BLOOM_WORDS))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.col("fp"), F.lit(64)).cast("int"))
    bitmap = F.broadcast(more.select(word.alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")))
    marked = lambda df: df.withColumn("word", word).join(bitmap, "word", "left").withColumn("routed", F.coalesce(F.col("bits").bitwiseAND(bit) != 0, F.lit(False)))
    routed = lambda df: marked(df).filter("routed")
    # byte verification: equal texts group together map-side, so one text per task and group is moved
    verified = routed(plain.select("norm", F.xxhash64("norm").alias("fp"))).groupBy("fp", "norm").agg(F.count("*").alias("n")).filter("n > 1")
    texts = verified.select("fp", F.sha2("norm", 256).alias("sha"), "n")
    best = routed(slim.select("rid", "doc_id", "points", "fp", "sha")).groupBy("fp", "sha").agg(
        F.min(F.struct((-F.col("points")).alias("less"), F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("rid"))).alias("b"))
    # written, so that the join below has an exchange of its own on either side, which AQE can split
    known = cut(texts.join(best, ["fp", "sha"]).select("fp", "sha", F.col("n").alias("group_size"), F.col("b.doc_id").alias("keep_id"), F.col("b.rid").alias("keep_rid")), "exact-groups")
    # only routed rows are moved to meet their group; all others are known to be single
    met = routed(slim).join(known, ["fp", "sha"], "left")
    alone = marked(slim).filter(~F.col("routed")).withColumns({"group_size": F.lit(1), "keep_id": F.lit(None), "keep_rid": F.lit(None)})
    shape = lambda df: df.select(
        "doc_id", F.when(F.col("keep_rid").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("keep_rid").isNull() | (F.col("keep_rid") == F.col("rid"))).alias("kept"), F.col("sha").alias("text_sha256"), *(["row"] if row else []))
    return shape(alone).unionByName(shape(met))


def keep_first(docs: DataFrame, **options) -> DataFrame:
    """The documents that stay, with their own columns."""
    return groups(docs, whole_rows=True, **options).filter("kept").select("row.*")
