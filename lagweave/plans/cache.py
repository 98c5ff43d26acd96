"""Features of an event set on disk, so that a later run over the same events reads them.

Values lie in one table per event set, partitioned by feature; each feature has a document
that states name, rows, checksum and seconds, and counts only if it states exactly these.  A
cache belongs to one table of transactions: the key is the event set."""

from __future__ import annotations

import hashlib
import math
import time
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.windows import Primitive
from ..operators.asof import event_features
from ..sources.tables import read_json, write_json

FIELDS = {"name", "rows", "checksum", "duration"}


def event_set_checksum(events: DataFrame) -> tuple[str, int]:
    """Digest and number of the events (m, t, id).  Rows are hashed one by one and the hashes are
    combined by sums and exclusive or, so neither order nor partitioning matters and nothing is
    sorted or collected."""
    digest = F.sha2(F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in ("m", "t", "id"))), 256)
    words = [F.conv(F.substring(digest, 1 + 15 * k, 15), 16, 10).cast("long") for k in range(4)]
    row = events.agg(F.count("*"), *(f for w in words for f in (F.sum(w.cast("decimal(38,0)")), F.bit_xor(w)))).first()
    return hashlib.sha256("|".join(str(x) for x in row).encode()).hexdigest(), row[0]


class FeatureCache:
    def __init__(self, folder: str | Path):
        self.folder = Path(folder)

    def _note(self, checksum: str, name: str) -> Path:
        return self.folder / checksum / f"{hashlib.sha256(name.encode()).hexdigest()[:32]}.json"

    def known(self, checksum: str, rows: int, names: Iterable[str]) -> set[str]:
        """The names whose values can be read; a note that is damaged or of other rows does not count."""
        out = set()
        for name in names:
            try:
                note = read_json(self._note(checksum, name))
            except (OSError, ValueError):
                continue
            if isinstance(note, dict) and set(note) == FIELDS and (note["name"], note["checksum"], note["rows"]) == (name, checksum, rows):
                if isinstance(note["duration"], (int, float)) and math.isfinite(note["duration"]) and note["duration"] >= 0:
                    out.add(name)
        return out

    def features(self, tx: DataFrame, events: DataFrame, primitives: Iterable[Primitive], keep: Iterable[str] = ()) -> DataFrame:
        """As ``event_features``; what is not known yet is computed in one pass and stored.  Ids
        of events must be distinct."""
        wanted, keep = {p.name: p for p in primitives}, list(keep)
        checksum, rows = event_set_checksum(events)
        missing = [p for n, p in wanted.items() if n not in self.known(checksum, rows, wanted)]
        values = str(self.folder / checksum / "values")
        if missing:
            began = time.perf_counter()
            made = event_features(tx, events, missing)
            long = made.select("id", F.explode(F.array(*(F.struct(F.lit(p.name).alias("name"), F.col(f"`{p.name}`").alias("value")) for p in missing))).alias("v")).select("id", "v.*")
            writer = long.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("name")  # only the partitions of these names
            writer.parquet(values)
            each = (time.perf_counter() - began) / len(missing)
            for p in missing:
                write_json(self._note(checksum, p.name), {"name": p.name, "rows": rows, "checksum": checksum, "duration": each}, force=True)
        names = list(wanted)
        stored = events.sparkSession.read.parquet(values).filter(F.col("name").isin(names))
        wide = stored.groupBy(F.col("id").alias("_at")).pivot("name", names).agg(F.first("value"))
        return events.select("id", *keep).join(wide, F.col("id") == F.col("_at"), "left").select("id", *keep, *(F.col(f"`{n}`") for n in names))
