"""Session helpers: shipping the package, shared storage and lineage cuts."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()
#: Scratch paths of each session that are still there.
_OWNED: dict[str, tuple[SparkSession, list[str]]] = {}
_SCOPES: list[list[str]] = []
#: Large rows that a reader holds at once.
LARGE_ROWS = 4


@contextmanager
def scratch_scope() -> Iterator[list[str]]:
    """Collects the scratch paths handed out inside, for whoever knows when their results are no longer read."""
    _SCOPES.append([])
    try:
        yield _SCOPES[-1]
    finally:
        _SCOPES.pop()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable on every executor (once per application)."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    folder = Path(tempfile.mkdtemp(prefix="ship-")).resolve()
    target = folder / f"{root.name}_src.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(p.relative_to(root.parent)))
    spark.sparkContext.addPyFile(str(target))
    _SHIPPED.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or one of our own where it is unset (tests)."""
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if configured is None and current.isEmpty():
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="eigenforge-"))
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
    return configured if configured is not None else current.get()


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark).rstrip('/')}/eigenforge/{name}-{uuid.uuid4().hex}"
    _OWNED.setdefault(spark._jsparkSession.sessionUUID(), (spark, []))[1].append(path)
    if _SCOPES:
        _SCOPES[-1].append(path)
    return path


def materialize(spark: SparkSession, df: DataFrame, name: str, large_rows: bool = False) -> tuple[DataFrame, str]:
    """Write df as Parquet in the shared folder and read it back: a lineage cut that outlives executors.

    large_rows: rows of megabytes lie in groups of few, since a reader holds up to 4096 rows of a group at once.
    """
    path = scratch_path(spark, name)
    writer = df.write.option("parquet.block.row.count.limit", LARGE_ROWS) if large_rows else df.write
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    paths = _OWNED.get(spark._jsparkSession.sessionUUID(), (spark, []))[1]
    if path in paths:
        paths.remove(path)


def close(spark: SparkSession) -> int:
    """Deletes the session's scratch tables; results that read them cannot be read any more. Gives their number.

    To be called once results are written or collected. What is left then goes when the driver's Python ends.
    """
    _, paths = _OWNED.pop(spark._jsparkSession.sessionUUID(), (spark, []))
    for path in paths:
        drop_path(spark, path)
    return len(paths)


@atexit.register
def _close_all() -> None:
    for spark, _ in list(_OWNED.values()):
        if spark.sparkContext._jsc is not None:  # else it was stopped, and its folder is out of reach
            close(spark)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
