"""WARC archives: writing with revisit records, reading with boundary-chain verification.

Writing: of pages with equal payloads of ``MIN_BYTES`` or more the one with the largest id is
a response record; the others are revisit records that name it.  Each task writes one file,
under a name that depends on its partition; a repeated task replaces it.

Reading: files are cut into ranges.  A task lists every place in its range where a record
could start, genuine or inside a payload, with the offset of its successor, and follows
successors inside the range.  Pointer jumping from each file's start over (offset, exit)
pairs finds the one offset at which the chain of genuine records enters each range; the
number of rounds is the logarithm of a file's number of ranges.  Records are then read
along the chain from these offsets, so a record header inside a payload is never taken for one.
A file whose chain does not end at its size with the manifest's number of records is an error.

Defined cases: a null page is an empty payload; null ids and urls are kept; ids that occur
twice give a record each; equal payloads without an id among them have no revisits; pages and
urls of any length are written and read whole; an empty table writes no file and gives an
empty result; further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, new_path, open_shared, publish_shared, release

MIN_BYTES = 1000
RANGE = 4 << 20
HEADER = 1 << 16  # bytes read at first for a header; longer ones are read to their end
DATE = "2024-01-01T00:00:00Z"
MAGIC = b"WARC/1.1\r\n"
SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the public name space for URLs
UNSAFE = re.compile(r"[\x00-\x20\x7f]")


def _name(page_id: int | None, url: str | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, f'{page_id}')}>" if page_id is not None else f"<urn:uuid:{uuid.uuid5(SPACE, f'url {url}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record with its closing line breaks."""
    sha = hashlib.sha1(payload).digest()
    head = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", _name(page_id, url)), ("WARC-Date", DATE),
            ("WARC-Payload-Digest", "sha1:" + base64.b32encode(sha).decode()), ("Content-Type", "application/http;msgtype=response")]
    if url is not None:
        head.append(("WARC-Target-URI", UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", url)))
    if page_id is not None:
        head.append(("X-Page-ID", str(page_id)))
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload
    if refers_to is not None:
        head += [("WARC-Refers-To", _name(refers_to, None)), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("X-Refers-To-Page", str(refers_to))]
        block = http
    head.append(("Content-Length", str(len(block))))
    return MAGIC + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse_header(data: bytes, at: int) -> tuple[dict[str, str], int] | None:
    """Fields of the record header at ``at`` and the offset of its block; None if it is none."""
    end = data.find(b"\r\n\r\n", at)
    if not data.startswith(MAGIC, at) or end < 0:
        return None
    fields = {}
    for line in data[at + len(MAGIC) : end].split(b"\r\n"):
        key, colon, value = line.partition(b":")
        if not colon:
            return None
        fields[key.decode("latin-1").lower()] = value.strip().decode("utf-8", "replace")
    return (fields, end + 4) if fields.get("content-length", "").isdigit() else None


def _to_header_end(file, data: bytes, begin: int, at: int, size: int) -> bytes:
    """``data``, which ``file`` holds from ``begin`` on, with more of it until the header at ``at`` ends."""
    while data.find(b"\r\n\r\n", at) < 0 and begin + len(data) < size:
        file.seek(begin + len(data))
        data += file.read(min(max(HEADER, len(data) - at), size - begin - len(data)))
    return data


def plan_records(pages: DataFrame, id_col="page_id", url_col="url", html_col="html") -> DataFrame:
    """(page_id, url, html, refers_to).  Equality is by SHA-256 and length; a group costs one
    row per task, and the table of groups is written, so its size decides how it is joined."""
    picked = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    keyed = picked.withColumn("sha", F.sha2("html", 256)).withColumn("size", F.octet_length("html"))
    large = keyed.filter(F.col("size") >= MIN_BYTES)
    shared = cut(large.groupBy("sha", "size").agg(F.max("page_id").alias("first_id"), F.count("*").alias("n")).filter("n > 1 and first_id is not null").select(F.col("sha").alias("s"), F.col("size").alias("z"), "first_id"), "warc-groups")
    joined = keyed.join(shared, (F.col("sha") == F.col("s")) & (F.col("size") == F.col("z")), "left")
    other = F.col("page_id").isNull() | (F.col("page_id") != F.col("first_id"))
    return joined.select("page_id", "url", "html", F.when(F.col("first_id").isNotNull() & other, F.col("first_id")).alias("refers_to"))


MANIFEST = "file string, bytes long, n_records long"


def write_archives(pages: DataFrame, folder: str, **columns) -> DataFrame:
    """One file per task; returns the manifest (file, bytes, n_records)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        final = f"{folder}/part-{TaskContext.get().partitionId():06d}.warc"
        temporary, out, size, n = f"{final}.{uuid.uuid4().hex}.tmp", None, 0, 0
        for batch in batches:
            for page_id, url, html, refers_to in zip(*(batch.column(k) for k in range(4)), strict=True):
                raw = record(page_id.as_py(), url.as_py(), html.as_py().encode("utf-8"), refers_to.as_py())
                out = out or open_shared(temporary, "wb")
                out.write(raw)
                size, n = size + len(raw), n + 1
        if out:
            out.close()
            publish_shared(temporary, final)
            yield pa.RecordBatch.from_pydict({"file": [final], "bytes": [size], "n_records": [n]})

    return cut(plan_records(pages, **columns).mapInArrow(run, MANIFEST), "warc-manifest")


def candidates(file, begin: int, end: int, size: int) -> list[tuple[int, int]]:
    """(offset, successor) of every place in [begin, end) where a record header stands."""
    file.seek(begin)
    data = file.read(min(size, end + HEADER) - begin)
    found, at = [], data.find(MAGIC)
    while 0 <= at < end - begin:
        data = _to_header_end(file, data, begin, at, size)
        if parsed := parse_header(data, at):
            found.append((begin + at, begin + parsed[1] + int(parsed[0]["content-length"]) + 4))
        at = data.find(MAGIC, at + 1)
    return found


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for row in (r for b in batches for r in b.to_pylist()):
        with open_shared(row["file"], "rb") as file:
            found = candidates(file, row["begin"], row["end"], row["bytes"])
        exits: dict[int, int] = {}
        counts: dict[int, int] = {}
        for offset, successor in reversed(found):  # None: the chain breaks inside the range
            exits[offset] = successor if successor >= row["end"] else exits.get(successor)
            counts[offset] = 1 + counts.get(successor, 0)
        n = len(found)
        yield pa.RecordBatch.from_arrays([pa.array([row["file"]] * n, pa.string()), pa.array([row["end"]] * n, pa.int64()), pa.array([row["bytes"]] * n, pa.int64()),
                                          pa.array([o for o, _ in found], pa.int64()), pa.array([s for _, s in found], pa.int64()), pa.array([exits[o] for o, _ in found], pa.int64()), pa.array([counts[o] for o, _ in found], pa.int64())],
                                         ["file", "end", "bytes", "offset", "successor", "exit", "records"])


def chain_entries(marks: DataFrame) -> DataFrame:
    """Where the chain from each file's start enters each range, where it leaves it and after how many
    records: (file, offset, end, bytes, exit, records).

    Only a candidate at which some other candidate's chain leaves a range, or which opens its
    file, can be an entry; there are a few such to a range, and the others are left out before
    pointers are followed.  After k rounds everything within 2^k jumps of the start is reached.
    All joins are by sorting: none of these tables has a bound that would allow a broadcast."""
    left = marks.filter("exit is not null and exit < bytes").select(F.col("file").alias("f"), F.col("exit").alias("at")).distinct()
    met = marks.join(left.hint("merge"), (marks["file"] == left["f"]) & (marks["offset"] == left["at"]), "left")
    heads = cut(met.filter("offset = 0 or at is not null").drop("f", "at"), "warc-heads")
    jumps = heads.filter("exit is not null and exit < bytes").select(F.col("file").alias("f"), F.col("offset").alias("from"), F.col("exit").alias("to"))
    reached = cut(heads.filter("offset = 0").select("file", "offset"), "warc-reached")
    n = reached.count()
    while True:
        step = reached.join(jumps.hint("merge"), (reached["file"] == jumps["f"]) & (reached["offset"] == jumps["from"])).select(reached["file"], F.col("to").alias("offset"))
        after = cut(reached.unionByName(step).distinct(), "warc-reached")
        release(reached)
        reached, before, n = after, n, after.count()
        if n == before:
            break
        a, b = jumps.alias("a"), jumps.alias("b")
        doubled = a.join(b.hint("merge"), (F.col("a.f") == F.col("b.f")) & (F.col("a.to") == F.col("b.from"))).select("a.f", "a.from", "b.to")
        older, jumps = jumps, cut(doubled, "warc-jumps")
        release(older)
    return heads.join(reached.hint("merge"), ["file", "offset"]).select("file", "offset", "end", "bytes", "exit", "records")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
    for row in (r for b in batches for r in b.to_pylist()):
        if row["exit"] is None:
            raise ValueError(f"{row['file']}: the chain of records breaks after offset {row['offset']}")
        rows = []
        with open_shared(row["file"], "rb") as file:
            at = row["offset"]
            while at < row["exit"]:
                file.seek(at)
                head = _to_header_end(file, file.read(HEADER), at, 0, row["bytes"])
                fields, block = parse_header(head, 0)
                length = int(fields["content-length"])
                body = head[block : block + length]
                body += file.read(length - len(body)) if len(body) < length else b""
                http, payload = body.split(b"\r\n\r\n", 1)
                stated = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
                size = int(re.search(rb"Content-Length: (\d+)", http)[1])
                if fields["warc-type"] == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != stated):
                    raise ValueError(f"{row['file']}: the payload at offset {at} is damaged")
                number = lambda k, f=fields: int(f[k]) if k in f else None
                rows.append((number("x-page-id"), size, stated, fields["warc-type"], number("x-refers-to-page"), fields.get("warc-target-uri")))
                at += block + length + 4
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def read_archives(manifest: DataFrame, span: int = RANGE) -> DataFrame:
    """One row per record: page_id, payload_bytes, payload_digest, record_type, refers_to, url."""
    begins = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(span).cast("long")))
    ranges = manifest.filter("bytes > 0").select("file", "bytes", begins.alias("begin")).withColumn("end", F.least(F.col("begin") + span, F.col("bytes")))
    total = manifest.agg(F.sum(F.ceil(F.col("bytes") / span))).first()[0] or 1
    marks = cut(ranges.repartition(int(total)).mapInArrow(_scan, "file string, end long, bytes long, offset long, successor long, exit long, records long"), "warc-marks")
    entries = cut(chain_entries(marks), "warc-entries")
    ends = entries.groupBy("file").agg(F.max("exit").alias("last"), F.sum("records").alias("n"))
    broken = manifest.join(ends, "file", "left").filter("bytes > 0 and not (last <=> bytes and n <=> n_records)").first()
    if broken:
        raise ValueError(f"{broken['file']}: the chain of records ends at {broken['last']} of {broken['bytes']} bytes with {broken['n']} of {broken['n_records']} records")
    return entries.repartition(int(total)).mapInArrow(_read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string")


def round_trip(pages: DataFrame, folder: str | None = None, span: int = RANGE, **columns) -> DataFrame:
    """Write and read back."""
    return read_archives(write_archives(pages, folder or new_path(pages.sparkSession, "warc"), **columns), span)
