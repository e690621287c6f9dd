"""Tables that cut lineage: Parquet in the folder that the cluster names in ``spark.checkpoint.dir``, which all machines share."""

from __future__ import annotations

import atexit
import contextlib
import gc
import re
import shutil
import tempfile
import time
import uuid
from collections.abc import Iterator

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

_ROWS, _BYTES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
_own: dict[str, str] = {}
_used: set[str] = set()
#: By folder: tables of the stages so far, and, inside a stage, its own.
_staged: dict[str, list[str]] = {}
_open: list[list[str]] = []


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of 2,048 rows in place of Spark's default of 10,000, as rows are whole texts here; another setting of the session's stays."""
    if spark.conf.get(_ROWS, "10000") == "10000":
        spark.conf.set(_ROWS, "2048")


def folder(spark: SparkSession) -> str:
    """Where tables go: the folder that the session names. Only a session on one machine may leave it unset, as in tests; it gets a temporary folder that goes at exit."""
    small_batches(spark)
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    app = spark.sparkContext.applicationId
    if not shared:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        if app not in _own:
            _own[app] = tempfile.mkdtemp(prefix="pagelore-")
            atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
        shared = f"file://{_own[app]}"
    return f"{shared.rstrip('/')}/pagelore-{app}"


def written(df: DataFrame) -> DataFrame:
    """``df`` computed once, written and read again. Any executor can be lost afterwards without computing it again.

    The session's tables go when the driver ends, or earlier by ``clear``.
    """
    spark = df.sparkSession
    at = folder(spark)
    if at not in _used:
        _used.add(at)
        atexit.register(_delete, *_jvm_path(spark, at))
    path = f"{at}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _open:
        _open[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def _jvm_path(spark: SparkSession, path: str) -> tuple:
    """The path and its file system, which outlive the session."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _delete(files, at) -> None:
    with contextlib.suppress(Py4JError):  # the JVM may be gone by then
        files.delete(at, True)


@contextlib.contextmanager
def stage(docs: DataFrame) -> Iterator[None]:
    """A stage whose input is ``docs``. The tables of stages before it are deleted when it begins, but those that ``docs`` still reads stay.

    So a stage's result has to be written, or handed on to the next stage, before another one begins. From the first stage on, the
    session's Arrow batches are of 2 MB in place of Spark's default of 64, as a worker's and its executor's copies of one are held
    at once; another setting of the session's stays.
    """
    spark = docs.sparkSession
    if spark.conf.get(_BYTES, "67108864b") == "67108864b":
        spark.conf.set(_BYTES, "2m")
    at, read = folder(spark), docs.inputFiles()
    for path in _staged.pop(at, []):
        if any(path.rsplit("/", 1)[1] in f for f in read):
            _staged.setdefault(at, []).append(path)
        else:
            _delete(*_jvm_path(spark, path))
    _open.append([])
    try:
        yield
    finally:
        _staged.setdefault(at, []).extend(_open.pop())


def _shuffles(spark: SparkSession) -> set[int]:
    """Shuffles whose files are kept."""
    ids = spark.sparkContext._jsc.sc().env().mapOutputTracker().shuffleStatuses().keysIterator()
    out = set()
    while ids.hasNext():
        out.add(ids.next())
    return out


def written_alone(df: DataFrame, most: float = 10.0) -> DataFrame:
    """``written``, after which the files of the shuffles that it took are deleted, where they would crowd the disks.

    Spark deletes them once the driver's garbage is collected, so that is asked for until they are gone, for ``most`` seconds at most.
    """
    spark = df.sparkSession
    before = _shuffles(spark)
    out = written(df)
    del df
    own, end = _shuffles(spark) - before, time.time() + most
    while own & _shuffles(spark) and time.time() < end:
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.2)
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete tables that ``written`` returned and that nothing reads any more."""
    for df in tables:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            _delete(*_jvm_path(df.sparkSession, path))


def clear(spark: SparkSession) -> None:
    """Delete the session's tables. Call it once results that were built on them are written."""
    files, at = _jvm_path(spark, folder(spark))
    files.delete(at, True)
