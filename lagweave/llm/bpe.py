"""Byte-level BPE: distinct words travel once, documents do not.

1. Tasks split texts with the tokenizer's pattern.  In blocks of about ``BLOCK_CHARS``
   characters they number the distinct pre-tokens and keep each document as a list of these
   numbers (its positions), in a file of the shared folder, packed into byte planes.
2. The block's distinct words go to buckets by a hash of the word, one packed row per block
   and bucket.  A bucket's task meets every block's copies of its words and encodes each
   distinct word once; its table of words is emptied at ``SEEN`` bytes, after which a word may
   be encoded a second time.
3. Ids go back to the block the same way and replace the numbers, position by position.
4. Decoding joins ids with the table of token bytes, which has one row per rank (50,256 in
   the files used) and is held by every task.

What is moved is each block's distinct words and their ids; a word that fills a third of the
corpus is one entry per block.  Block files have names that depend on the partition and the
block's number in it, so a repeated task writes the same file again.

Defined cases: a null text is empty and has no ids; null document ids are kept; repeated rows
are encoded each for itself; a very long text is never cut, and above the block size it is a
block of its own; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bitplanes import pack, unpack
from .shared import new_path, open_shared, publish_shared, shuffle_count

BLOCK_CHARS = 8_000_000
SEEN = 256 << 20  # bytes of the words a bucket's task remembers
ENTRY = 150  # bytes of an entry besides its word and ids


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


class ByteEncoder:
    """Ranks and pattern of a tokenizer, with its pieces encoded by the public library."""

    def __init__(self, path: str, pattern: str):
        import regex
        import tiktoken

        ranks = load_ranks(path)
        self.inner = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.split = regex.compile(pattern).findall
        tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            tokens[rank] = token
        self.lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.begins = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)

    def piece(self, word: bytes) -> list[int]:
        return self.inner._encode_single_piece(word)

    def whole(self, text: str) -> list[int]:
        """Ids of a whole text; the library's own splitter gives up on some very long runs,
        which are then split here."""
        try:
            return self.inner.encode_ordinary(text)
        except BaseException as error:  # noqa: BLE001  the library's panics are no Exceptions
            if isinstance(error, (KeyboardInterrupt, SystemExit, MemoryError)):
                raise
            return [i for w in self.split(text) for i in self.piece(w.encode("utf-8"))]


_encoders: dict[tuple[str, str], ByteEncoder] = {}


def encoder(path: str, pattern: str) -> ByteEncoder:
    if (path, pattern) not in _encoders:
        _encoders[path, pattern] = ByteEncoder(path, pattern)
    return _encoders[path, pattern]


class Numbers(dict):
    """Numbers keys in the order of their first use."""

    def __missing__(self, key):
        value = self[key] = len(self)
        return value


def gather(flat: np.ndarray, begins: np.ndarray, lengths: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The pieces ``which`` of ``flat``, one after the other."""
    n = lengths[which]
    shift = begins[which] - (np.cumsum(n) - n)
    return flat[np.repeat(shift, n) + np.arange(int(n.sum()))]


def pack_words(words: list[bytes]) -> bytes:
    lengths = np.fromiter(map(len, words), "<u4", len(words)).tobytes()
    return zstandard.ZstdCompressor(level=3).compress(struct.pack("<I", len(words)) + lengths + b"".join(words))


def unpack_words(blob: bytes) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    (n,) = struct.unpack_from("<I", raw)
    ends = (4 + 4 * n + np.cumsum(np.frombuffer(raw, "<u4", n, 4).astype(np.int64))).tolist()
    return [raw[a:b] for a, b in zip([4 + 4 * n, *ends], ends, strict=False)]


def _block_path(folder: str, block: int) -> str:
    return f"{folder}/block-{block >> 32:06d}-{block & 0xFFFFFFFF:06d}.seq"


def _write_block(folder: str, block: int, ids: list, counts: list[int], numbers: np.ndarray) -> None:
    nulls = np.array([i is None for i in ids], "u1").tobytes()
    head = zstandard.ZstdCompressor().compress(nulls + np.array([i or 0 for i in ids], "<i8").tobytes() + np.array(counts, "<u4").tobytes())
    parts = pack(numbers)
    temporary = f"{_block_path(folder, block)}.{uuid.uuid4().hex}.tmp"
    with open_shared(temporary, "wb") as out:
        out.write(struct.pack("<QQI4I", len(ids), len(numbers), len(head), *map(len, parts)) + head + b"".join(parts))
    publish_shared(temporary, _block_path(folder, block))


def _read_block(folder: str, block: int) -> tuple[list, np.ndarray, np.ndarray]:
    with open_shared(_block_path(folder, block), "rb") as file:
        n, m, h, *lengths = struct.unpack("<QQI4I", file.read(36))
        head = zstandard.ZstdDecompressor().decompress(file.read(h))
        numbers = unpack([file.read(x) for x in lengths], m)
    ids = [None if none else i for none, i in zip(head[:n], np.frombuffer(head, "<i8", n, n).tolist(), strict=True)]
    return ids, np.frombuffer(head, "<u4", n, 9 * n).astype(np.int64), numbers.astype(np.int64)


ROWS = "block long, bucket int, packed binary"


def _row(block: int, bucket: int, packed: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([bucket], pa.int32()), pa.array([packed], pa.binary())], ["block", "bucket", "packed"])


def _splitter(folder: str, path: str, pattern: str, buckets: int, block_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, serial, split = TaskContext.get().partitionId() << 32, 0, encoder(path, pattern).split
        ids, counts, held, numbers, chars = [], [], [], Numbers(), 0

        def flush():
            words = [w.encode("utf-8") for w in numbers]
            bucket = np.fromiter((zlib.crc32(w) % buckets for w in words), np.int64, len(words))
            order = np.lexsort((np.arange(len(words)), bucket))
            number = np.empty(len(words), "<u4")
            number[order] = np.arange(len(words))
            every = np.concatenate(held) if held else np.empty(0, np.int64)
            _write_block(folder, base + serial, ids, counts, number[every])
            ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
            for b in range(buckets):
                if ends[b] < ends[b + 1]:
                    yield _row(base + serial, b, pack_words([words[i] for i in order[ends[b] : ends[b + 1]]]))
            if not words:  # documents without a word must be met again as well
                yield _row(base + serial, 0, pack_words([]))

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = split(text.as_py() or "")
                ids.append(doc_id)
                counts.append(len(found))
                held.append(np.fromiter(map(numbers.__getitem__, found), np.int64, len(found)))
                chars += len(text.as_py() or "")
                if chars >= block_chars:
                    yield from flush()
                    ids, counts, held, numbers, chars, serial = [], [], [], Numbers(), 0, serial + 1
        if ids:
            yield from flush()
    return run


def _word_encoder(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, seen, size, now = encoder(path, pattern), {}, 0, None
        for batch in batches:
            for block, bucket, blob in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if bucket != now or size > SEEN:
                    seen, size, now = {}, 0, bucket
                words = unpack_words(blob)
                for word in words:
                    if word not in seen:
                        ids = seen[word] = np.array(own.piece(word), "<u4").tobytes()
                        size += len(word) + len(ids) + ENTRY
                yield _row(block, bucket, pack_words([seen[w] for w in words]))
    return run


def _assembler(folder: str, path: str, pattern: str):
    names = ["doc_id", "n_tokens", "ids", "decoded"]

    def rows(block: int, blobs: list[bytes], digests: bool) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern)
        pieces = [p for blob in blobs for p in unpack_words(blob)]
        lengths = np.fromiter((len(p) // 4 for p in pieces), np.int64, len(pieces))
        flat, begins = np.frombuffer(b"".join(pieces), "<u4"), np.cumsum(lengths) - lengths
        ids, counts, numbers = _read_block(folder, block)
        ends = np.cumsum(counts)
        out = []
        for doc_id, a, b in zip(ids, (ends - counts).tolist(), ends.tolist(), strict=True):
            tokens = gather(flat, begins, lengths, numbers[a:b])
            raw, text = tokens.astype("<u4").tobytes(), gather(own.bytes, own.begins, own.lengths, tokens.astype(np.int64)).tobytes()
            out.append((doc_id, len(tokens), hashlib.sha256(raw).hexdigest(), hashlib.sha256(text).hexdigest()) if digests else (doc_id, len(tokens), raw, text))
            if len(out) == 2000:
                yield batch(out, digests)
                out = []
        if out:
            yield batch(out, digests)

    def batch(out, digests):
        kind = pa.string() if digests else pa.binary()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), kind, kind), strict=True)], names)

    def make(digests: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, blobs = None, []
            for part in batches:
                for block, blob in zip(part.column(0).to_pylist(), part.column(2).to_pylist(), strict=True):
                    if block != now and blobs:
                        yield from rows(now, blobs, digests)
                        blobs = []
                    now = block
                    blobs.append(blob)
            if blobs:
                yield from rows(now, blobs, digests)
        return run
    return make


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, id_col="doc_id", text_col="text", digests: bool = False, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids (little-endian 32-bit), decoded (bytes);
    with ``digests`` the last two as lowercase hex SHA-256."""
    spark: SparkSession = docs.sparkSession
    folder, parts = new_path(spark, "bpe"), shuffle_count(spark)
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    words = picked.mapInArrow(_splitter(folder, ranks_path, pattern, parts, block_chars), ROWS)
    encoded = words.repartition(parts, "bucket").sortWithinPartitions("bucket", "block").mapInArrow(_word_encoder(ranks_path, pattern), ROWS)
    kind = "string" if digests else "binary"
    back = encoded.repartition(parts, "block").sortWithinPartitions("block", "bucket")
    return back.mapInArrow(_assembler(folder, ranks_path, pattern)(digests), f"doc_id long, n_tokens long, ids {kind}, decoded {kind}")
