"""A catalog of runs: states, parameters, metrics and artifacts, one JSON document a run.

A document is replaced atomically, so a reader never meets half a run; listings are a
DataFrame over the documents."""

from __future__ import annotations

import shutil
import time
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import read_json, write_json

# States and the moves between them.
MOVES = {"running": {"search_failed", "interrupted", "search_complete", "analysis_failed", "complete"}, "search_complete": {"analysis_failed", "complete"},
         "analysis_failed": {"complete", "analysis_failed"}, "complete": {"complete"}, "search_failed": set(), "interrupted": set()}
COLUMNS = "run_id string, strategy string, seed long, grp string, state string, error string, start_time double, params map<string,string>, metrics map<string,double>"


class RunStateError(ValueError):
    """An action that the state of its run does not allow."""


class RunCatalog:
    def __init__(self, root: str | Path):
        self.root = Path(root)
        (self.root / "runs").mkdir(parents=True, exist_ok=True)

    def _path(self, run_id: str) -> Path:
        return self.root / "runs" / run_id / "run.json"

    def create(self, strategy: str, seed: int | None = None, group: str | None = None, params: dict | None = None) -> str:
        run_id = uuid.uuid4().hex
        write_json(self._path(run_id), {"run_id": run_id, "strategy": strategy, "seed": seed, "grp": group, "state": "running", "error": None, "start_time": time.time(),
                                        "params": {k: str(v) for k, v in (params or {}).items()}, "metrics": {}})
        return run_id

    def get(self, run_id: str) -> dict:
        return read_json(self._path(run_id))

    def _update(self, run_id: str, **changes) -> None:
        write_json(self._path(run_id), self.get(run_id) | changes, force=True)

    def move(self, run_id: str, state: str, error: str | None = None) -> None:
        now = self.get(run_id)["state"]
        if state not in MOVES[now]:
            raise ValueError(f"a run cannot go from {now} to {state}")
        self._update(run_id, state=state, error=error)

    def require(self, run_id: str, states: tuple[str, ...], action: str) -> None:
        """Recovery acts only on runs it applies to."""
        now = self.get(run_id)["state"]
        if now not in states:
            raise RunStateError(f"{action} needs a run in state {' or '.join(states)}; {run_id} is in state {now}")

    def log_metrics(self, run_id: str, metrics: dict[str, float]) -> None:
        self._update(run_id, metrics=self.get(run_id)["metrics"] | {k: float(v) for k, v in metrics.items()})

    def upload(self, run_id: str, source: str | Path, name: str) -> Path:
        target = self.root / "runs" / run_id / "artifacts" / name
        target.parent.mkdir(parents=True, exist_ok=True)
        (shutil.copytree if Path(source).is_dir() else shutil.copy2)(source, target)
        return target

    def download(self, run_id: str, name: str) -> Path:
        target = self.root / "runs" / run_id / "artifacts" / name
        if not target.exists():
            raise FileNotFoundError(str(target))
        return target

    def delete(self, run_id: str) -> None:
        shutil.rmtree(self.root / "runs" / run_id)

    def search(self, spark: SparkSession, states=None, strategies=None, groups=None, max_results: int | None = None) -> DataFrame:
        """Newest first."""
        if not any((self.root / "runs").glob("*/run.json")):
            return spark.createDataFrame([], COLUMNS)
        df = spark.read.schema(COLUMNS).option("multiLine", True).json(str(self.root / "runs" / "*" / "run.json"))
        for column, wanted in (("state", states), ("strategy", strategies), ("grp", groups)):
            if wanted:
                df = df.filter(F.col(column).isin(*wanted))
        df = df.orderBy(F.desc("start_time"), "run_id")
        return df.limit(max_results) if max_results else df
