"""Run bundles: made in a staging folder, published whole by one rename, or kept under
``partial/`` when a run fails; and the life-cycle files that grow with a search."""

from __future__ import annotations

import csv
import os
import shutil
import uuid
from pathlib import Path

from ..sources.tables import write_json
from .archive import Archive
from .report import verify_bundle, write_manifest

PARTIAL = "partial"


def added_keys(before: set[str], after: set[str]) -> set[str]:
    """Keys that came between two snapshots; an archive never loses one."""
    if lost := before - after:
        raise ValueError(f"the archive lost {len(lost)} member(s)")
    return after - before


def shares_members(members: set[str], active: set[str]) -> bool:
    """Whether every member of the active set is in the archive."""
    return active <= members


class Lifecycle:
    """Candidate and generation rows and a snapshot of the archive, one file each per generation."""

    def __init__(self, folder: str | Path, mapping: dict, candidates: list[str], generations: list[str]):
        self.folder, self.mapping, self.headers, self.keys = Path(folder), mapping, {"candidates": candidates, "generations": generations}, set()

    def _write(self, table: str, generation: int, rows: list[tuple]) -> None:
        path = self.folder / table / f"generation-{generation:06d}.csv"
        path.parent.mkdir(parents=True, exist_ok=True)
        staged = path.with_name(f".{path.name}.{uuid.uuid4().hex}.tmp")
        with open(staged, "w", encoding="utf-8", newline="") as file:
            out = csv.writer(file, lineterminator="\n", escapechar="\\", doublequote=False)
            out.writerow(self.headers[table])
            out.writerows([["" if v is None else str(v).lower() if isinstance(v, bool) else v for v in r] for r in rows])
        os.replace(staged, path)

    def generation(self, number: int, candidates: list[tuple], row: tuple, archive: Archive | None) -> None:
        if archive is not None:
            keys = {m.key for m in archive.members}
            new = added_keys(self.keys, keys)
            write_json(self.folder / "snapshots" / f"generation-{number:06d}.json", {"generation": number, "added": sorted(new), "archive": archive.to_document(self.mapping)}, force=True)
            self.keys = keys
        self._write("candidates", number, candidates)
        self._write("generations", number, [row])


class Bundle:
    """A run's folder in the making.  Nothing is seen at ``destination`` before ``publish``."""

    def __init__(self, destination: str | Path, run_id: str, strategy: str, force: bool = False):
        self.destination, self.run_id, self.strategy, self.force = Path(destination), run_id, strategy, force
        if self.destination.exists() and not force:
            raise FileExistsError(f"{self.destination} exists; use force to replace it")
        if self.destination.is_symlink() or (self.destination.exists() and not self.destination.is_dir()):
            raise ValueError(f"{self.destination} is no folder")
        self.staging = self.destination.parent / f".{self.destination.name}.{uuid.uuid4().hex}.staging"
        self.staging.mkdir(parents=True)

    def publish(self, inputs: dict[str, str], configuration: dict) -> Path:
        write_manifest(self.staging, self.run_id, self.strategy, inputs, configuration)
        return self._move(self.destination)

    def fail(self, error: BaseException) -> Path:
        """What there is goes under ``partial/``, with the reason; it has no final archive."""
        (self.staging / "archive.json").unlink(missing_ok=True)
        write_json(self.staging / "status.json", {"run_id": self.run_id, "strategy": self.strategy, "state": "failed", "error": f"{type(error).__name__}: {error}"}, force=True)
        return self._move(self.destination.parent / PARTIAL / self.destination.name)

    def discard(self) -> None:
        shutil.rmtree(self.staging, ignore_errors=True)

    def _move(self, target: Path) -> Path:
        target.parent.mkdir(parents=True, exist_ok=True)
        old = target.with_name(f".{target.name}.{uuid.uuid4().hex}.old") if target.exists() else None
        if old:
            os.replace(target, old)
        try:
            os.replace(self.staging, target)
        except BaseException:
            if old:
                os.replace(old, target)
            raise
        if old:
            shutil.rmtree(old)
        return target


def open_bundle(folder: str | Path) -> Path:
    """A published bundle whose artifacts are as they were written."""
    folder = Path(folder)
    if not (folder / "manifest.json").exists():
        raise ValueError(f"{folder} is no complete bundle")
    if changed := verify_bundle(folder):
        raise ValueError(f"changed since the run: {', '.join(changed)}")
    return folder
