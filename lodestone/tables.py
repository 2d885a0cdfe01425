"""Intermediate tables in the folder that all executors share, and who deletes them."""

from __future__ import annotations

import atexit
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``.

    Where that is unset a local session (tests) gets a temporary folder; on a cluster this raises.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lodestone-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Tables by path, with the Hadoop path object and its file system; what is left at the end of the process goes then.
_made: dict[str, tuple] = {}
_owner: ContextVar[list[str] | None] = ContextVar("owner", default=None)


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing else uses; it belongs to the :func:`owned` block around, if any."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    _made[path] = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop
    if (own := _owner.get()) is not None:
        own.append(path)
    return path


#: Spark removes the shuffle files of a query when it has ended.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_lock, _writers, _before = threading.Lock(), 0, None


@contextmanager
def _cleaning(spark: SparkSession) -> Iterator[None]:
    """Shuffle files go with their query while any write of :func:`cut` runs."""
    global _writers, _before
    with _lock:
        if not _writers:
            _before = spark.conf.get(_CLEAN, None)
            spark.conf.set(_CLEAN, "true")
        _writers += 1
    try:
        yield
    finally:
        with _lock:
            _writers -= 1
            if not _writers:
                spark.conf.unset(_CLEAN) if _before is None else spark.conf.set(_CLEAN, _before)


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again.

    This ends the lineage, so a lost executor costs a re-read and never a re-run of
    what came before; it also freezes generated ids. The shuffle files of the write go with it.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    with _cleaning(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def _delete(*paths: str) -> None:
    for path in paths:
        if path in _made:
            system, hadoop = _made.pop(path)
            system.delete(hadoop, True)


def release(*tables: DataFrame) -> None:
    """Delete tables of :func:`cut` that nothing will read again."""
    _delete(*(t._scratch_path for t in tables))


@contextmanager
def owned(keep: list[DataFrame]) -> Iterator[None]:
    """Tables made within the block are deleted after it, but for those that the block puts into ``keep``."""
    token = _owner.set([])
    try:
        yield
    finally:
        made = _owner.get()
        _owner.reset(token)
        kept = {t._scratch_path for t in keep}
        _delete(*(p for p in made if p not in kept))
        if (outer := _owner.get()) is not None:
            outer.extend(kept & set(made))


@atexit.register
def _at_exit() -> None:
    for path in list(_made):
        try:
            _delete(path)
        except Exception:  # noqa: BLE001  the session is gone; its folder is the cluster's to clear
            return
