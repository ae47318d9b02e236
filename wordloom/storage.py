"""Tables written between the steps of an iterative operator.

A written table cuts the lineage and outlives any executor.  The folder is the
one the cluster names in ``spark.checkpoint.dir``; only where that is unset (a
test on one machine) a temporary folder is made.
"""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []
_own: list[str] = []
#: Spark's setting under which a query's shuffle files go when the query ends, not when the driver next collects its garbage.
_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if spark.sparkContext.getCheckpointDir():
        return spark.sparkContext.getCheckpointDir().rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own:
        _own.append("file://" + tempfile.mkdtemp(prefix="wordloom-"))
    return _own[0]


def workspace(spark: SparkSession, label: str) -> str:
    """A fresh folder below the shared one, deleted when the driver ends."""
    path = f"{shared_dir(spark)}/wordloom/{label}-{uuid.uuid4().hex[:12]}"
    _written.append((spark, path))
    return path


@contextlib.contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Queries that run inside leave no shuffle files behind."""
    before = spark.conf.get(_TIDY, None)
    spark.conf.set(_TIDY, "true")
    try:
        yield
    finally:
        spark.conf.unset(_TIDY) if before is None else spark.conf.set(_TIDY, before)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back with its own schema."""
    spark = df.sparkSession
    path = workspace(spark, label)
    with tidy(spark):
        df.write.mode("overwrite").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete tables made by :func:`materialize` of which nothing is read again."""
    for t in tables:
        _written[:] = [x for x in _written if x[1] != t._written_to]
        remove(t.sparkSession, t._written_to)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder through Hadoop, wherever it lies."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def read_text(spark: SparkSession, path: str) -> str | None:
    """The content of a small file, or None if there is none."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return jvm.java.lang.String(stream.readAllBytes(), "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file, which appears under its name only when it is whole."""
    jvm = spark.sparkContext._jvm
    target, part = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex[:8]}")
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    stream = fs.create(part, True)
    stream.write(bytearray(text.encode()))
    stream.close()
    fs.delete(target, False)
    if not fs.rename(part, target):
        raise OSError(f"cannot write {path}")


@atexit.register
def _sweep() -> None:
    for spark, path in _written:
        with contextlib.suppress(Exception):
            remove(spark, path)
    for path in _own:
        shutil.rmtree(path.removeprefix("file://"), ignore_errors=True)
