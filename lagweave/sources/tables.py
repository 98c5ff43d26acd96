"""Parquet, CSV and JSON sources and sinks with overwrite guards and schema checks."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def require_columns(df: DataFrame, names: Iterable[str], what: str = "input") -> None:
    """ValueError that names the missing columns in sorted order."""
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"{what} is missing required column(s): {', '.join(missing)}")


def read_parquet(spark: SparkSession, path: str | os.PathLike) -> DataFrame:
    """A table; one whose rewrite was interrupted between its two renames is put back first."""
    path = str(path)
    recover_rewrite(spark, path)
    fs, at = _store(spark, path)
    if not any(c in path for c in "*?[{") and not fs.exists(at):
        raise FileNotFoundError(path)
    return spark.read.parquet(path)


def _store(spark: SparkSession, path: str | os.PathLike):
    """The Hadoop file system of a path, whatever store it is in, and the path in full."""
    context = spark.sparkContext
    at = context._jvm.org.apache.hadoop.fs.Path(str(path) if "://" in str(path) else os.path.abspath(path))
    fs = at.getFileSystem(context._jsc.hadoopConfiguration())
    return fs, fs.makeQualified(at)


def guard_output(path: str | os.PathLike, force: bool, inputs: Iterable[str | os.PathLike] = (), spark: SparkSession | None = None) -> None:
    """Refuse an output that is an input, and an existing one without ``force``.  With a session
    the path's own store is asked, else the local disk."""
    if spark is None:
        same = any(os.path.abspath(path) == os.path.abspath(p) for p in inputs)
        there = os.path.exists(path)
    else:
        fs, at = _store(spark, path)
        same = any(at.equals(_store(spark, p)[1]) for p in inputs)
        there = fs.exists(at)
    if same:
        raise ValueError(f"input and output are the same: {path}")
    if there and not force:
        raise FileExistsError(f"{path} exists; use force to replace it")


def write_parquet(df: DataFrame, path: str | os.PathLike, force: bool = False, inputs: Iterable = ()) -> None:
    guard_output(path, force, inputs, df.sparkSession)
    df.write.mode("overwrite" if force else "errorifexists").option("compression", "zstd").parquet(str(path))


def rewrite_parquet(df: DataFrame, path: str | os.PathLike) -> None:
    """Replace a table that ``df`` may read: write beside it, then swap by two renames.  If the
    second fails the old table comes back; if the program ends between them, the next
    ``read_parquet`` or rewrite of the path puts it back."""
    spark, path = df.sparkSession, str(path)
    recover_rewrite(spark, path)
    fs, at = _store(spark, path)
    part = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    staged, old = part(f"{at}.{uuid.uuid4().hex}.tmp"), part(f"{at}.{uuid.uuid4().hex}.old")
    df.write.option("compression", "zstd").parquet(staged.toString())
    had = fs.exists(at)
    if had and not fs.rename(at, old):
        fs.delete(staged, True)
        raise OSError(f"{path} cannot be moved aside")
    if not fs.rename(staged, at):
        if had:
            fs.rename(old, at)
        raise OSError(f"{path} cannot be replaced")
    if had:
        fs.delete(old, True)


def recover_rewrite(spark: SparkSession, path: str | os.PathLike) -> bool:
    """Put back the table that an interrupted rewrite moved aside, if nothing took its place."""
    fs, at = _store(spark, path)
    if any(c in str(path) for c in "*?[{") or fs.exists(at) or at.getParent() is None or not fs.exists(at.getParent()):
        return False
    part = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    left = fs.globStatus(part(f"{at}.*.old"))
    return bool(len(left) == 1 and fs.rename(left[0].getPath(), at))


NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType)


def micros(column: str | Column, kind: T.DataType) -> Column:
    """Microseconds since the epoch; times without a zone are read as UTC in any session."""
    c = F.col(column) if isinstance(column, str) else column
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(c)
    seconds = F.unix_date(c.cast("date")).cast("long") * 86400
    if isinstance(kind, T.DateType):
        return seconds * 1000000
    within = F.hour(c) * 3600 + F.minute(c) * 60
    return (seconds + within) * 1000000 + (F.extract(F.lit("SECOND"), c) * 1000000).cast("long")


def numeric_projection(df: DataFrame) -> DataFrame:
    """The storage form: numbers as they are, decimals as doubles, timestamps as microseconds,
    dates as days, nulls as 0; other columns are left out."""
    kept = []
    for field in df.schema:
        c, kind = F.col(f"`{field.name}`"), field.dataType
        if isinstance(kind, NUMERIC):
            out = c
        elif isinstance(kind, T.DecimalType):
            out = c.cast("double")
        elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            out = micros(c, kind)
        elif isinstance(kind, T.DateType):
            out = F.unix_date(c)
        else:
            continue
        kept.append(F.coalesce(out, F.lit(0)).alias(field.name))
    return df.select(*kept)


def materialize(df: DataFrame, folder: str | os.PathLike, force: bool = False) -> dict:
    """Write the storage form with a manifest; the row count is checked against the files."""
    write_parquet(numeric_projection(df), Path(folder) / "columns", force)
    back = df.sparkSession.read.parquet(str(Path(folder) / "columns"))
    rows = back.count()
    if rows != df.count():
        raise ValueError("written rows differ from input rows")
    manifest = {"rows": rows, "columns": {f.name: {"file": "columns", "dtype": f.dataType.simpleString()} for f in back.schema}}
    write_json(Path(folder) / "manifest.json", manifest, force=True)
    return manifest


def load_columns(spark: SparkSession, folder: str | os.PathLike, columns: Iterable[str] | None = None) -> DataFrame:
    manifest = read_manifest(folder)
    names = list(columns) if columns is not None else list(manifest["columns"])
    unknown = sorted(set(names) - set(manifest["columns"]))
    if unknown:
        raise ValueError(f"unknown column(s): {', '.join(unknown)}")
    return spark.read.parquet(str(Path(folder) / "columns")).select(*names)


def read_manifest(folder: str | os.PathLike) -> dict:
    return read_json(Path(folder) / "manifest.json")


def read_json(path: str | os.PathLike) -> dict:
    with open(path, encoding="utf-8") as file:
        return json.load(file)


def write_json(path: str | os.PathLike, value, force: bool = False) -> None:
    """Atomic: readers see the old document or the new one."""
    path = Path(path)
    guard_output(path, force)
    path.parent.mkdir(parents=True, exist_ok=True)
    staged = path.with_name(f"{path.name}.{uuid.uuid4().hex}.tmp")
    with open(staged, "w", encoding="utf-8") as file:
        json.dump(value, file, indent=2)
        file.flush()
        os.fsync(file.fileno())
    os.replace(staged, path)


def dataset_paths(folder: str | os.PathLike, recursive: bool = False) -> list[Path]:
    return sorted(Path(folder).rglob("*.parquet") if recursive else Path(folder).glob("*.parquet"))


def write_csv(df: DataFrame, path: str | os.PathLike, schema: T.StructType, force: bool = False) -> None:
    if df.columns != schema.names:
        raise ValueError(f"expected columns {schema.names}, got {df.columns}")
    guard_output(path, force, (), df.sparkSession)
    df.write.mode("overwrite" if force else "errorifexists").option("header", True).csv(str(path))


def as_numbers(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Columns as finite doubles; text that is no number, and what is not finite, becomes null."""
    value = lambda c: F.expr(f"try_cast(`{c}` AS DOUBLE)")
    return df.withColumns({c: F.when(~F.isnan(value(c)) & (F.abs(value(c)) < float("inf")), value(c)) for c in columns})


def read_csv(spark: SparkSession, path: str | os.PathLike, schema: T.StructType) -> DataFrame:
    """The header must be that of the schema, name by name."""
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(str(path))


def seed_runs(spark: SparkSession, folder: str | os.PathLike) -> DataFrame:
    """Summaries ``seed_<n>/*-summary.json`` and ``*-summary.json`` with their seed."""
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*-summary.json").option("multiLine", True).json(str(folder))
    return raw.withColumn("file", F.input_file_name()).withColumn("seed", F.expr("try_cast(regexp_extract(file, 'seed_([0-9]+)/', 1) AS INT)"))
