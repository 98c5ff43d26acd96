"""Helpers used by all operators: shared folder, lineage cuts, word expressions."""

from __future__ import annotations

import atexit
import contextlib
import os
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The white space of every text contract, as a regular expression class
# and as characters.
SPACE = r"[\x20\x09-\x0D]"
NOT_SPACE = r"[^\x20\x09-\x0D]"
SPACE_CHARS = " \t\n\x0b\x0c\r"

FEW = 8
FILE_ROWS = 250_000  # rows of a narrow table that are worth a file

_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where the setting is absent a temporary folder is made, but only in local mode,
    where one machine is the whole cluster; elsewhere the absence is an error.
    """
    conf, context = spark.sparkContext.getConf(), spark.sparkContext
    found = conf.get("spark.checkpoint.dir")
    if found:
        # with its scheme, so that Spark and plain file access mean one place
        path = context._jvm.org.apache.hadoop.fs.Path(found)
        return path.getFileSystem(context._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")
    if not conf.get("spark.master", "").startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = context.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = tempfile.mkdtemp(prefix="lagweave-")
        atexit.register(shutil.rmtree, _own_dirs[app], True)
    return _own_dirs[app]


_work_dirs: dict[str, str] = {}


def work_dir(spark: SparkSession) -> str:
    """This application's folder below the shared one.  It is removed when the driver ends;
    until then results may still be read from it."""
    app = spark.sparkContext.applicationId
    if app not in _work_dirs:
        _work_dirs[app] = f"{shared_dir(spark)}/lagweave-{app}"
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_work_dirs[app])
        atexit.register(_remove, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path)
    return _work_dirs[app]


def _remove(store, path) -> None:
    with contextlib.suppress(Exception):  # the driver's JVM may be gone already
        store.delete(path, True)


def release_all(spark: SparkSession) -> None:
    """Delete every intermediate table and file of this application; results that were not
    written elsewhere go with them."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(work_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def new_path(spark: SparkSession, label: str) -> str:
    return f"{work_dir(spark)}/{label}-{uuid.uuid4().hex}"


def few(rows: int, each: int = FILE_ROWS) -> int:
    """Files that a narrow table of at most ``rows`` rows is worth."""
    return max(FEW, -(-rows // each))


def cut(df: DataFrame, label: str, files: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, so a lost
    executor costs a reread, and later plans see the table's real size.

    ``files`` bounds the files, and the tasks that write them.  Where the folder is in Hadoop's
    local store each file costs three launches of ``chmod``."""
    spark = df.sparkSession
    path = new_path(spark, label)
    (df if files is None else df.coalesce(files)).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lagweave_path = path
    return out


def release(df: DataFrame) -> None:
    """Delete a table made by ``cut`` that no live plan reads any more."""
    path = getattr(df, "_lagweave_path", None)
    if path is None:
        return
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def local_path(path: str) -> str:
    """A ``file:`` URI as a path; other paths as they are."""
    return path[7:] if path.startswith("file://") else path.removeprefix("file:")


def open_shared(path: str, mode: str):
    """Open a file of the shared folder on an executor, by whatever store it is in."""
    local = local_path(path)
    if "://" not in local:
        if "w" in mode:
            os.makedirs(os.path.dirname(local), exist_ok=True)
        return open(local, mode)
    store, inner = _store(path)
    if "w" in mode:
        store.create_dir(os.path.dirname(inner), recursive=True)
        return store.open_output_stream(inner)
    return store.open_input_file(inner)


def publish_shared(written: str, final: str) -> None:
    """Give a finished file its final name; the last finished attempt of a task wins, and
    all attempts write the same bytes."""
    if "://" not in local_path(written):
        os.replace(local_path(written), local_path(final))
        return
    (store, inner), target = _store(written), _store(final)[1]
    if store.get_file_info(target).is_file:  # of an earlier attempt
        store.delete_file(target)
    store.move(inner, target)


def _store(path: str):
    from pyarrow import fs

    scheme, rest = path.split("://", 1)
    return fs.FileSystem.from_uri(f"{'s3' if scheme in ('s3a', 's3n') else scheme}://{rest}")


def word_count(text: Column) -> Column:
    """Number of runs of non-space characters; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(NOT_SPACE + "+")), F.lit(0)).cast("long")


def words(text: Column) -> Column:
    """The runs of non-space characters in order; null or blank gives an empty array."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE + "+"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shuffle_count(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
