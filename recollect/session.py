"""Session settings the engine relies on, and lineage cuts."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SHIPPED: set[str] = set()

#: Rows that Spark sends to a Python worker at once: whole texts may be long, and the batch is
#: outside the heap.
ROWS_AT_ONCE = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def prepare(spark: SparkSession) -> SparkSession:
    """Pin UTC, which results depend on, and ship this package to the Python workers.

    The ids of one answer, 400 at most, may reach the Parquet scan one by one instead of
    as a range. Every other setting stays as the cluster made it.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.parquet.pushdown.inFilterThreshold", "400")
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        package = os.path.dirname(os.path.abspath(__file__))
        folder = tempfile.mkdtemp(prefix="recollect-ship-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)  # executors fetch it until then
        target = os.path.join(folder, "recollect")
        archive = shutil.make_archive(
            target, "zip", root_dir=os.path.dirname(package), base_dir=os.path.basename(package)
        )
        context.addPyFile(archive)
        _SHIPPED.add(context.applicationId)
    return spark


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the cluster.

    A folder of our own is chosen only where none is configured, which on a
    multi-node master would be wrong, so that case is refused.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="recollect-checkpoint-")
    spark.sparkContext.setCheckpointDir(own)
    return spark.sparkContext.getCheckpointDir()


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """What is run meanwhile sends ROWS_AT_ONCE rows to a worker at once, or fewer where the cluster says so."""
    before = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, str(min(ROWS_AT_ONCE, int(before)) if int(before) > 0 else ROWS_AT_ONCE))
    try:
        yield
    finally:
        spark.conf.set(_BATCH, before)


class Scratch:
    """Intermediate results as tables in the checkpoint folder, until closed.

    A kept result is computed once and survives the loss of executors; later reads take
    only the columns they need. It is computed with small batches to the workers; the setting is put back.
    """

    def __init__(self, spark: SparkSession):
        self._spark = spark
        self._folder = f"{checkpoint_folder(spark)}/recollect-{uuid.uuid4().hex}"
        self._n = 0
        # A result may be read after this is out of scope; what is not closed goes with the application.
        path = spark._jvm.org.apache.hadoop.fs.Path(self._folder)
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)

    def keep(self, df: DataFrame, **options: str) -> DataFrame:
        self._n += 1
        path = f"{self._folder}/{self._n}"
        with small_batches(self._spark):
            df.write.options(**options).parquet(path)
        return self._spark.read.schema(df.schema).parquet(path)

    def keep_by(self, df: DataFrame, column: str) -> DataFrame:
        """As ``keep``, in a folder for each value of ``column``: what filters on it reads no others.

        Rows of a value are brought together, but not more of them than make a file of normal size.
        """
        self._n += 1
        path = f"{self._folder}/{self._n}"
        with small_batches(self._spark):
            df.hint("rebalance", column).write.partitionBy(column).parquet(path)
        return self._spark.read.schema(df.schema).parquet(path)

    def close(self) -> None:
        path = self._spark._jvm.org.apache.hadoop.fs.Path(self._folder)
        path.getFileSystem(self._spark._jsc.hadoopConfiguration()).delete(path, True)

    def __enter__(self) -> "Scratch":
        return self

    def __exit__(self, *_) -> None:
        self.close()


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` kept for as long as the checkpoint folder lasts."""
    return Scratch(df.sparkSession).keep(df)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Give CPU-heavy work at least one partition per core.

    Only a scan with fewer splits than cores is redistributed; a large table
    has more splits than that and is left alone, so nothing is shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, *keys)


def broadcast_if_small(df: DataFrame, max_rows: int = 1_000_000) -> DataFrame:
    """Mark ``df`` for broadcast where counting shows it fits; otherwise joins shuffle.

    For narrow rows of a few numbers that are cheap to read again.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def estimated_bytes(df: DataFrame) -> int:
    """Spark's own size estimate for ``df``; nothing is run."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
