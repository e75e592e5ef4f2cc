"""Tables in the folder that driver and executors share: how lineage is cut without losing it with an executor."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

#: Spark's setting to delete the shuffle files of a query as soon as it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Spark's setting for how many bytes go to Python at once, and what holds while tables are written: wide rows (whole
#: texts, sets) would else fill batches of 64 MB a task, on both sides.
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where it is unset, one of our own if all run
    on this machine; on a cluster that is an error, for executors could not read each other's files."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
        folder = tempfile.mkdtemp(prefix="brindle-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


@contextlib.contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of queries that end meanwhile go at once, so that a job of many steps needs the disk of one, and what
    goes to Python goes in small batches."""
    before = {k: spark.conf.get(k, None) for k in (CLEANUP, BATCH)}
    spark.conf.set(CLEANUP, "true")
    spark.conf.set(BATCH, BATCH_BYTES)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def written(df: DataFrame, tag: str) -> DataFrame:
    """Cut the lineage: write ``df`` as a table in the shared folder and read it back. Lost executors lose nothing."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/brindle-{tag}-{uuid.uuid4().hex}"
    with tidy(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._brindle_path = path
    if not _WRITTEN:
        atexit.register(discard_all)
    _WRITTEN.add(path)
    return out


#: Tables of this application that are still there.
_WRITTEN: set[str] = set()


def _delete(path: str) -> None:
    spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    _WRITTEN.discard(path)


def discard(df: DataFrame) -> None:
    """Delete a table made by :func:`written` that nothing will read again."""
    _delete(df._brindle_path)


def discard_all() -> None:
    """Delete all tables that this application has written and not discarded: once its results are written, or as it ends
    with its session still up. What a lazy result still reads must not be among them."""
    if SparkSession.getActiveSession() is not None:
        for path in sorted(_WRITTEN):
            with contextlib.suppress(Exception):
                _delete(path)
