"""Run bundles: fingerprinted manifests, the figure tables, and a page of them."""

from __future__ import annotations

import hashlib
import html
import json
import math
import os
import uuid
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import statistics as st
from ..sources.tables import read_csv, read_json, write_csv, write_json
from .expressions import to_document
from .search import CANDIDATES, GENERATIONS

FOLDS = ["Split1", "Split2", "Split3"]
STATUSES = ["generated", "duplicate", "materialization_failed", "invalid", "evaluated"]


def fingerprint(path: str | Path) -> str:
    """SHA-256 of a file, or of the names and contents of a folder's files in order."""
    digest, path = hashlib.sha256(), Path(path)
    for file in [path] if path.is_file() else sorted(p for p in path.rglob("*") if p.is_file() and p.suffix != ".crc"):
        if path.is_dir():
            digest.update(str(file.relative_to(path)).encode() + b"\0")
        with open(file, "rb") as f:
            while block := f.read(1 << 20):
                digest.update(block)
    return digest.hexdigest()


def feature_id(document: dict) -> str:
    return "feat_" + hashlib.sha256(json.dumps(document, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:12]


def write_manifest(folder: str | Path, run_id: str, strategy: str, inputs: dict[str, str], configuration: dict) -> None:
    folder = Path(folder)
    artifacts = {p.name: fingerprint(p) for p in sorted(folder.iterdir()) if not p.name.startswith("manifest")}
    write_json(folder / "manifest.json", {"run_id": run_id, "strategy": strategy, "created_at_utc": datetime.now(UTC).isoformat(), "inputs": {k: fingerprint(v) for k, v in inputs.items()},
                                          "artifacts": artifacts, "configuration": configuration})
    (folder / "manifest.sha256").write_text(fingerprint(folder / "manifest.json"))


def verify_bundle(folder: str | Path) -> list[str]:
    """Names of artifacts that are missing or were changed."""
    folder = Path(folder)
    if fingerprint(folder / "manifest.json") != (folder / "manifest.sha256").read_text():
        return ["manifest.json"]
    stated = json.loads((folder / "manifest.json").read_text())["artifacts"]
    return [n for n, digest in stated.items() if not (folder / n).exists() or fingerprint(folder / n) != digest]


# The columns of the final evaluation's tables.
FINAL = {
    "features": "feature_id string, feature_label string, search_fold_1 double, search_fold_2 double, search_fold_3 double",
    "importances": "feature_id string, feature_label string, importance_mean double, importance_std double",
    "correlations": "feature_id string, feature_label string, other_feature_id string, other_feature_label string, spearman double, training_row_count long",
    "timings": "feature_id string, feature_label string, materialization_seconds double",
}
NEVER = {"model", "predictions", "accuracy"}


def final_tables(spark: SparkSession, report: dict, members: list, codes, training_rows: int) -> dict[str, DataFrame]:
    """The tables of a ``forest_report``: features with their search scores, importances, rank
    correlations and costs.  ``members`` are the archive's, in the order of the report."""
    ids = {f"x{i}": feature_id(to_document(m.expr)) for i, m in enumerate(members)}
    labels = {f"x{i}": m.expr.text(codes) for i, m in enumerate(members)}
    finite = lambda v: float(v) if v is not None and math.isfinite(v) else None
    scores = [[finite(v) for v in (list(m.objectives) + [None] * 4)[:4]] for m in members]
    rows = {
        "features": [(ids[x], labels[x], *s[:3]) for x, s in zip(ids, scores, strict=True)],
        "importances": [(ids[x], labels[x], float(mean), float(std)) for x, mean, std in report["importances"]],
        "correlations": [(ids[a], labels[a], ids[b], labels[b], finite(rho), training_rows) for a, b, rho in report["spearman"]],
        "timings": [(ids[x], labels[x], s[3]) for x, s in zip(ids, scores, strict=True)],
    }
    return {name: spark.createDataFrame(rows[name], schema) for name, schema in FINAL.items()}


def write_final(folder: str | Path, tables: dict[str, DataFrame], metrics: dict[str, float], force: bool = False) -> None:
    """``evaluation/<table>`` as CSV and ``evaluation/metrics.json``; numbers only, no model."""
    if set(tables) != set(FINAL):
        raise ValueError(f"the tables are {', '.join(FINAL)}")
    if bad := [k for k, v in metrics.items() if k in NEVER or not isinstance(v, (int, float)) or not math.isfinite(v)]:
        raise ValueError(f"no metrics: {', '.join(sorted(bad))}")
    for name, df in tables.items():
        write_csv(df.coalesce(1), Path(folder) / "evaluation" / name, T._parse_datatype_string(FINAL[name]), force)
    write_json(Path(folder) / "evaluation" / "metrics.json", {"format": "lagweave-final-evaluation", "schema_version": 1, **metrics}, force)


def read_final(spark: SparkSession, folder: str | Path) -> tuple[dict[str, DataFrame], dict]:
    """The tables, with their headers checked, and the metrics."""
    metrics = read_json(Path(folder) / "evaluation" / "metrics.json")
    if not isinstance(metrics, dict) or metrics.get("format") != "lagweave-final-evaluation" or metrics.get("schema_version") != 1 or NEVER & set(metrics):
        raise ValueError("not the metrics of a final evaluation")
    return {n: read_csv(spark, Path(folder) / "evaluation" / n, T._parse_datatype_string(s)) for n, s in FINAL.items()}, metrics


def figure_tables(candidates: DataFrame, generations: DataFrame, importances: DataFrame | None = None, spearman: DataFrame | None = None) -> dict[str, DataFrame]:
    """The tables of the eleven figures; those without data are left out."""
    scored = candidates.filter("Status = 'evaluated'")
    spread = st.row_spread(scored, FOLDS)
    finite = scored.filter(F.col("MaterializationTime").isNotNull() & (F.abs("MaterializationTime") < float("inf")))
    members = candidates.filter("ArchiveMember")
    tables = {
        "outcomes": st.outcome_table(candidates, "Generation", "Status", STATUSES),
        "archive_size": generations.select("Generation", "ArchiveSize", "Added"),
        "scores": st.scores_by_generation(scored, "Generation", FOLDS),
        "fold_stability": st.quartiles(spread, "Generation", "fold_sd"),
        "materialization_time": st.quartiles(finite, "Generation", "MaterializationTime"),
        "score_versus_time": finite.withColumn("Score", st.row_mean(FOLDS)).select("CandidateIndex", "Score", "MaterializationTime").dropna(),
        "final_folds": members.filter(F.coalesce(*FOLDS).isNotNull()).select("Expression", *FOLDS),
        "presence": st.presence_counts(members, "Expression"),
        "progress": st.progress(generations, "Generation", "Evaluated").join(generations.select("Generation", "CumulativeRuntimeSeconds"), "Generation"),
    }
    if importances is not None:
        top = importances.orderBy(F.desc("importance"), "feature").limit(20)
        tables["importance"] = top
        if spearman is not None:
            names = [r.feature for r in top.collect()]
            tables["spearman"] = spearman.filter(F.col("left").isin(*names) & F.col("right").isin(*names)).groupBy("left").pivot("right", names).agg(F.first("rho"))
    return tables


def write_report(spark: SparkSession, folder: str | Path, **extra) -> Path:
    """A new version of the report of a saved run; earlier versions stay."""
    folder = Path(folder)
    tables = figure_tables(read_csv(spark, folder / "candidates", CANDIDATES), read_csv(spark, folder / "generations", GENERATIONS), **extra)
    number = 1 + len(list(folder.glob("report-*.html")))
    staged, final = folder / f".{uuid.uuid4().hex}.tmp", folder / f"report-{number}.html"
    with open(staged, "w", encoding="utf-8") as page:
        page.write("<!doctype html><meta charset=utf-8><title>Run</title>")
        for name, df in tables.items():
            page.write(f"<h2>{html.escape(name)}</h2><table><tr>{''.join(f'<th>{html.escape(c)}</th>' for c in df.columns)}</tr>")
            for r in df.toLocalIterator():  # whole tables, a partition at a time
                page.write("<tr>" + "".join(f"<td>{html.escape('' if v is None else str(v))}</td>" for v in r) + "</tr>")
            page.write("</table>")
    os.replace(staged, final)
    return final
