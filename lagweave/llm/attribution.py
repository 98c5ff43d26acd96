"""Token counts per section by offset-mapped attribution.

A document is encoded once, as a whole.  Token byte spans follow from the lengths of the
tokens; they are joined with the section spans by binary search on the section starts.  A
token inside one section counts there.  A token that crosses a boundary counts, whole, for
the section that holds most of its bytes, and for the earlier one on a tie; it is also
counted as crossing there.  So the counts of a document add up to its number of tokens.

Sections are the lines of a text, each with its line break; ``fields`` works on several
columns, whose texts are encoded as one with a line break between them, which belongs to the
field before it.

Defined cases: a null or empty text has one empty section and no tokens; null fields are
empty; null ids are kept; repeated rows are counted each for itself; a very long text is
encoded whole, in one task; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import encoder

NAMES = ["doc_id", "section", "start", "end", "n_tokens", "n_crossing"]
SCHEMA = "doc_id long, section long, start long, end long, n_tokens long, n_crossing long"


def allocate(lengths: np.ndarray, starts: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and crossing tokens of each section.  ``lengths``: bytes of the tokens;
    ``starts``: first byte of each section, ascending from 0; ``total``: bytes in all."""
    ends = np.cumsum(lengths)
    begins = ends - lengths
    first = np.searchsorted(starts, begins, "right") - 1
    last = np.searchsorted(starts, ends - 1, "right") - 1
    crossing = np.flatnonzero(first != last)
    bounds = np.append(starts, total)
    owner = first.copy()
    for t in crossing.tolist():
        cuts = np.clip(bounds[first[t] : last[t] + 2], begins[t], ends[t])
        owner[t] = first[t] + int(np.argmax(np.diff(cuts)))
    return np.bincount(owner, minlength=len(starts)), np.bincount(owner[crossing], minlength=len(starts))


def _line_starts(raw: bytes) -> np.ndarray:
    """First byte of each line; a break at the very end opens no further line."""
    breaks = np.flatnonzero(np.frombuffer(raw, np.uint8) == 10) + 1
    return np.append(0, breaks[breaks < len(raw)])


def _points(raw: bytes, at: np.ndarray) -> np.ndarray:
    """Code points before each of the byte offsets."""
    if raw.isascii():
        return at
    leads = np.append(0, np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80))
    return leads[at]


def _counter(path: str, pattern: str, many: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern)
        out, held = [], 0

        def ready():
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c) if k else [x for part in c for x in part], pa.int64()) for k, c in enumerate(zip(*out, strict=True))], NAMES)

        for batch in batches:
            for doc_id, cell in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                value = cell.as_py()
                if many:
                    fields = [(f or "") for f in value]
                    raw = "\n".join(fields).encode("utf-8")
                    sizes = np.array([len(f.encode("utf-8")) + 1 for f in fields])
                    starts = np.cumsum(sizes) - sizes
                else:
                    raw = (value or "").encode("utf-8")
                    starts = _line_starts(raw)
                lengths = own.lengths[np.array(own.whole(raw.decode("utf-8")), np.int64)]
                tokens, crossing = allocate(lengths, starts, len(raw))
                edges = _points(raw, np.append(np.minimum(starts, len(raw)), len(raw)))
                out.append(([doc_id] * len(starts), np.arange(len(starts)), edges[:-1], edges[1:], tokens, crossing))
                held += len(starts)
                if held >= 20_000:
                    yield ready()
                    out, held = [], 0
        if out:
            yield ready()
    return run


def sections(docs: DataFrame, ranks_path: str, pattern: str, id_col="doc_id", text_col="text") -> DataFrame:
    """One row per document and line: doc_id, section (from 0), start, end (code points, end
    exclusive), n_tokens, n_crossing."""
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return picked.mapInArrow(_counter(ranks_path, pattern, False), SCHEMA)


def fields(docs: DataFrame, columns: list[str], ranks_path: str, pattern: str, id_col="doc_id") -> DataFrame:
    """As ``sections``, with one section per column."""
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.array(*(F.col(c).cast("string") for c in columns)).alias("texts"))
    return picked.mapInArrow(_counter(ranks_path, pattern, True), SCHEMA)
