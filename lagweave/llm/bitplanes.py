"""Token ids in binary shards: byte planes of fixed-size blocks, zstandard, a chunk index.

A shard is ``BPL1``, its chunks, a footer and the footer's length.  A chunk holds
``block`` ids (the last one fewer) as 32-bit integers, transposed into four byte planes (or
32 bit planes), each compressed by itself.  The footer has the chunk index (offset, ids,
kind of plane, compressed length of each plane) and the documents (id, number of ids).

Shards are written by the tasks of one range partitioning by document id, under names that
depend on the partition only; a finished file replaces that of a lost attempt.  Texts are encoded a word at
a time where a tokenizer file allows it: if probes show that its normaliser and pre-tokenizer
do not look across white space, a word's ids do not depend on its neighbours, and each worker
keeps a bounded table of words it has seen.  Other files, and texts with the string of an
added token (which the library turns into that token's id), are encoded whole by the library.

Defined cases: a null text is empty and has the end id alone; null document ids come first;
rows that share an id are ordered, and dealt to shards, by a hash of their text; a very long
text is encoded whole and stored over as many chunks as it takes; an empty table writes no
shard and gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import cut, few, new_path, open_shared, publish_shared

MAGIC = b"BPL1"
BLOCK = 1 << 16
READ_IDS = 1 << 26  # ids that are worth a task of reading back, of about a second
MARKS = re.compile("[̀-ͯ]")
# lower-case Latin-1 letters in UTF-8, then perhaps closing punctuation: such words pass the
# normaliser unchanged and are one or two pre-tokens
PLAIN_WORD = re.compile(rb"((?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+)([.,;:!?]*)")
PROBES = ("a", "word", "thing,", "\u00e9t\u00e9", "stra\u00dfe...", "na\u00efvely?!")
CASED = "Some WORDS, McGee's, X\u00c9Y"
SPACED = ("two words", "It's (a) test", "12 34,5", "\u6587 \u5b57!", "end. \u00abSo\u00bb")


def pack(ids: np.ndarray, planes: str = "byte") -> list[bytes]:
    """Compressed planes of one block of ids."""
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    compress = zstandard.ZstdCompressor(level=3).compress
    if planes == "byte":
        return [compress(np.ascontiguousarray(raw[:, k]).tobytes()) for k in range(4)]
    bits = np.unpackbits(raw, axis=1, bitorder="little")
    return [compress(np.packbits(bits[:, k], bitorder="little").tobytes()) for k in range(32)]


def unpack(parts: list[bytes], n: int) -> np.ndarray:
    """The ids of a block from its planes; 4 planes are bytes, 32 are bits."""
    expand = zstandard.ZstdDecompressor().decompress
    if len(parts) == 4:
        return np.stack([np.frombuffer(expand(p), np.uint8) for p in parts], 1).reshape(-1).view("<u4")
    bits = np.stack([np.unpackbits(np.frombuffer(expand(p), np.uint8), bitorder="little", count=n) for p in parts], 1)
    return np.packbits(bits, axis=1, bitorder="little").reshape(-1).view("<u4")


class ShardWriter:
    """Streams documents into a shard; holds one block and 16 bytes a document."""

    def __init__(self, out, block: int = BLOCK, planes: str = "byte"):
        self.out, self.block, self.planes = out, block, planes
        self.at, self.held, self.n_held, self.index, self.docs, self.n_ids = 4, [], 0, [], [], 0
        out.write(MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id is None, doc_id or 0, len(ids)))
        self.n_ids += len(ids)
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= self.block:
            every = np.concatenate(self.held)
            full = len(every) // self.block * self.block
            for a in range(0, full, self.block):
                self._chunk(every[a : a + self.block])
            self.held, self.n_held = [every[full:]], len(every) - full

    def _chunk(self, ids: np.ndarray) -> None:
        parts = pack(ids, self.planes)
        self.index.append(struct.pack(f"<QIB{len(parts)}I", self.at, len(ids), len(parts), *map(len, parts)))
        for p in parts:
            self.out.write(p)
            self.at += len(p)

    def close(self) -> int:
        if self.n_held:
            self._chunk(np.concatenate(self.held))
        docs = np.array(self.docs, dtype="<u1,<i8,<u4").tobytes() if self.docs else b""
        footer = struct.pack("<I", len(self.index)) + b"".join(self.index) + zstandard.ZstdCompressor().compress(docs)
        self.out.write(footer + struct.pack("<Q", len(footer)) + MAGIC)
        return self.at + len(footer) + 12


def read_shard(file) -> Iterator[tuple[int | None, int, int, int]]:
    """(doc_id, start in the shard, ids, crc32 of the ids) in order; one chunk in memory."""
    file.seek(0, 2)
    size = file.tell()
    file.seek(size - 12)
    length, end = struct.unpack("<Q4s", file.read(12))
    file.seek(0)
    if end != MAGIC or file.read(4) != MAGIC:
        raise ValueError("not a complete shard")
    file.seek(size - 12 - length)
    footer = file.read(length)
    (n_chunks,), at, index = struct.unpack_from("<I", footer), 4, []
    for _ in range(n_chunks):
        offset, n, k = struct.unpack_from("<QIB", footer, at)
        index.append((offset, n, struct.unpack_from(f"<{k}I", footer, at + 13)))
        at += 13 + 4 * k
    docs = np.frombuffer(zstandard.ZstdDecompressor().decompress(footer[at:]), "<u1,<i8,<u4")

    def chunks():
        for offset, n, lengths in index:
            file.seek(offset)
            yield unpack([file.read(x) for x in lengths], n)

    rest, source, start = np.empty(0, "<u4"), chunks(), 0
    for none, doc_id, n in docs.tolist():
        crc, left = 0, n
        while left > len(rest):
            crc, left = zlib.crc32(rest.tobytes(), crc), left - len(rest)
            rest = next(source)
        crc, rest = zlib.crc32(rest[:left].tobytes(), crc), rest[left:]
        yield None if none else doc_id, start, n, crc
        start += n


def byte_characters() -> dict[int, str]:
    """The characters that byte-level vocabularies write for bytes: printable Latin-1 for
    itself, the others numbered from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class WordEncoder:
    """Ids of texts, as the library gives them without special tokens around them.

    ``by_word`` tells whether probes allow words to be encoded one at a time, and ``lowers``
    whether ASCII capitals make no difference.  New plain words go straight to the BPE model, if that gives the probes the ids of the
    whole pipeline; all others go through the pipeline together, with a separator between
    them.  ``limit`` bounds the table of words, which is emptied when full."""

    SEPARATOR = "\x01"

    def __init__(self, path: str, limit: int = 1_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.inner = Tokenizer.from_file(path)
        added = sorted(t.content for t in self.inner.get_added_tokens_decoder().values())
        self.added = re.compile("|".join(map(re.escape, added)), re.I) if added else None
        # a text without these pieces, which have no case, holds no added token
        self.pieces = {max(re.split("[^\\W\\d_]+", t), key=len) for t in added}
        self.tokenize = self.inner.model.tokenize
        self.mark = self._piped(self.SEPARATOR)
        self.limit, self.seen, self.tails, self.chars = limit, {}, {b"": b""}, byte_characters()
        self.direct = True
        self.by_word = all(self._piped(x) == [i for w in x.split() for i in self._piped(w)] == self._piped(x.replace(" ", "\n \t")) for x in SPACED)
        self.lowers = self._piped(CASED) == self._piped("".join(c.lower() if c.isascii() else c for c in CASED))
        self.direct = self.by_word and all(self._plain(w.encode("utf-8")) == np.array(self._piped(w), "<u4").tobytes() for w in PROBES)

    def _piped(self, text: str) -> list[int]:
        return self.inner.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _plain(self, word: bytes) -> bytes | None:
        match = PLAIN_WORD.fullmatch(word) if self.direct else None
        if match is None:
            return None
        letters, tail = match.groups()
        if tail not in self.tails:
            self.tails[tail] = np.array(self._piped(tail.decode()), "<u4").tobytes()
        known = self.seen.get(letters)
        if known is None:
            ids = [t.id for t in self.tokenize(letters.decode("latin-1").translate(self.chars))]
            known = self.seen[letters] = struct.pack(f"<{len(ids)}I", *ids)
        return known + self.tails[tail]

    def _learn(self, new: list[bytes]) -> None:
        other = []
        for word in new:
            ids = self._plain(word)
            if ids is None:
                other.append(word)
            else:
                self.seen[word] = ids
        odd = [w for w in other if b"\x01" in w or len(self.mark) != 1]
        other = [w for w in other if b"\x01" not in w and len(self.mark) == 1]
        for at in range(0, len(other), 2000):
            some = other[at : at + 2000]
            ids = np.array(self._piped(f" {self.SEPARATOR} ".join(w.decode("utf-8") for w in some)), "<u4")
            ends = np.append(np.flatnonzero(ids == self.mark[0]), len(ids)) if some else []
            if len(ends) != len(some):
                odd += some
                continue
            raw, begins = ids.tobytes(), np.append(0, ends[:-1] + 1)
            self.seen.update(zip(some, (raw[a:b] for a, b in zip((4 * begins).tolist(), (4 * ends).tolist(), strict=True)), strict=True))
        for word in odd:
            self.seen[word] = np.array(self._piped(word.decode("utf-8")), "<u4").tobytes()

    def _whole(self, text: str | None) -> bool:
        return not self.by_word or bool(text and self.added and any(p in text for p in self.pieces) and self.added.search(text))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        split, whole = [], list(map(self._whole, texts))
        for text, alone in zip(texts, whole, strict=True):
            if alone:
                split.append([])
                continue
            raw = (text or "").encode("utf-8")
            # ASCII letters may be lowered first unless a mark could join them
            split.append(raw.lower().split() if text and self.lowers and not MARKS.search(text) else raw.split())
        if len(self.seen) > self.limit:
            self.seen = {}
        new = set().union(*split).difference(self.seen) if split else ()
        if new:
            self._learn(list(new))
        get = self.seen.__getitem__
        return [np.array(self._piped(text or ""), "<u4").tobytes() if alone else b"".join(map(get, words)) for text, alone, words in zip(texts, whole, split, strict=True)]


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One per worker process, kept between tasks."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def in_slices(texts: list, most: int = 2_000_000) -> Iterator[slice]:
    """Slices of a batch with about ``most`` characters each."""
    low = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= most:
            yield slice(low, i + 1)
            low, size = i + 1, 0
    if low < len(texts):
        yield slice(low, len(texts))


MANIFEST = "shard int, file string, n_docs long, n_ids long, bytes long"


def write_shards(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int, id_col="doc_id", text_col="text", block: int = BLOCK, planes: str = "byte") -> DataFrame:
    """Write the shards of ``docs`` in ascending order of ids; returns the manifest, one row per shard."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, writer, end = TaskContext.get().partitionId(), None, np.array([end_id], "<u4")
        final = f"{folder}/shard-{shard:06d}.bpl"
        temporary = f"{final}.{uuid.uuid4().hex}.tmp"
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for part in in_slices(texts := texts.to_pylist()):
                for doc_id, raw in zip(ids[part], encoder(tokenizer_path).encode(texts[part]), strict=True):
                    writer = writer or ShardWriter(open_shared(temporary, "wb"), block, planes)
                    writer.add(doc_id, np.append(np.frombuffer(raw, "<u4"), end))
        if writer:
            size = writer.close()
            writer.out.close()
            publish_shared(temporary, final)
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "file": [final], "n_docs": [len(writer.docs)], "n_ids": [writer.n_ids], "bytes": [size]})

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    place = ["doc_id", F.xxhash64("text")]  # the hash deals rows of one id to several ranges
    ordered = picked.repartitionByRange(*place).sortWithinPartitions(*place)
    # one file, behind an exchange of a row per shard: the shards are still written by all tasks
    return cut(ordered.mapInArrow(run, MANIFEST).repartition(1), "bpl-manifest")


def read_shards(manifest: DataFrame) -> DataFrame:
    """One row per document of the shards: doc_id, start, n_tokens, ids_crc32, shard.

    Starts are running sums over the manifest, which has a row per shard and no more.  A task
    reads several small shards, one after the other, since its rows may become a file."""
    before = F.coalesce(F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = manifest.select("shard", "file", before.alias("before"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "n_tokens", "ids_crc32"]
        for row in (r for b in batches for r in b.to_pylist()):
            with open_shared(row["file"], "rb") as file:
                rows = []
                for doc_id, start, n, crc in read_shard(file):
                    rows.append((doc_id, row["before"] + start, n, crc))
                    if len(rows) == 10_000:
                        yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in zip(*rows, strict=True)), pa.array([row["shard"]] * len(rows), pa.int32())], [*names, "shard"])
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in zip(*rows, strict=True)), pa.array([row["shard"]] * len(rows), pa.int32())], [*names, "shard"])

    n = manifest.agg(F.count("*").alias("shards"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_docs", "n_ids"))).first()
    tasks = min(n.shards, max(few(n.n_docs), -(-n.n_ids // READ_IDS)))
    return placed.repartition(max(tasks, 1)).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, shard int")


def encode_to_shards(spark: SparkSession, docs: DataFrame, tokenizer_path: str, end_id: int, folder: str | None = None, **options) -> DataFrame:
    """Write and read back."""
    return read_shards(write_shards(docs, folder or new_path(spark, "bpl"), tokenizer_path, end_id, **options))
