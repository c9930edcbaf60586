"""Tables in the folder that all executors share, for steps whose lineage has to end."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Spark's setting that removes an execution's shuffle files at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_lock = threading.Lock()
#: Writes under way in each session, and what its setting was before the first of them.
_writing: dict[int, tuple[int, str | None]] = {}
_recorded: ContextVar[list[str] | None] = ContextVar("recorded", default=None)


@contextmanager
def _cleaned_up(spark: SparkSession) -> Iterator[None]:
    """``CLEANUP`` is on while any thread of the session writes, and as it was before when the last one is done."""
    session = id(spark._jsparkSession)
    with _lock:
        n, before = _writing.get(session, (0, spark.conf.get(CLEANUP, None)))
        _writing[session] = n + 1, before
        spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        with _lock:
            n, before = _writing.pop(session)
            if n > 1:
                _writing[session] = n - 1, before
            elif before is None:
                spark.conf.unset(CLEANUP)
            else:
                spark.conf.set(CLEANUP, before)


@contextmanager
def recorded() -> Iterator[list[str]]:
    """The folders of all tables that are written inside, also by what runs inside and records its own."""
    made: list[str] = []
    outer = _recorded.set(made)
    try:
        yield made
    finally:
        _recorded.reset(outer)
        if (around := _recorded.get()) is not None:
            around += made


def shared_dir(spark: SparkSession) -> str:
    """This application's part of the folder the cluster names in ``spark.checkpoint.dir``.

    Only a session in one process, where all tasks see the driver's disk, gets a folder of its own when
    that is unset; on a cluster it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="trackloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return f"{found.rstrip('/')}/trackloom/{spark.sparkContext.applicationId}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    This cuts lineage: a lost executor later costs a re-read, not a recomputation. Spark is told to drop
    the shuffle files of this one write when it is done, as nothing reads them again.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    with _cleaned_up(spark):
        df.write.parquet(path)
    if (made := _recorded.get()) is not None:
        made.append(path)
    return spark.read.schema(schema).parquet(path)


def read_by(*tables: DataFrame) -> set[str]:
    """The folders of files that ``tables`` read."""
    return {f.rsplit("/", 1)[0] for df in tables for f in df.inputFiles()}


def discard_made(spark: SparkSession, made: list[str], *kept: DataFrame) -> None:
    """Delete the recorded tables that none of ``kept`` reads; those stay recorded."""
    ends = {folder.rsplit("/", 1)[-1] for folder in read_by(*kept)}  # names are unique, whatever way the path is written
    for folder in [x for x in made if x.rsplit("/", 1)[-1] not in ends]:
        _delete(spark, folder)
        made.remove(folder)


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialise`` wrote, once what was made of them is written too."""
    for df in tables:
        for folder in read_by(df):
            if f"/trackloom/{df.sparkSession.sparkContext.applicationId}/" in folder:
                _delete(df.sparkSession, folder)


def drop_tables(spark: SparkSession) -> None:
    """Delete every table of this application, when no result that reads them is needed any more."""
    _delete(spark, shared_dir(spark))


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
