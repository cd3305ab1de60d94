"""Working tables in the folder that all executors share.

Lineage is cut by writing Parquet under ``spark.checkpoint.dir`` and reading it
back, so a lost executor never loses a finished step.  Shuffle files of each
write are removed as soon as it ends.
"""

from __future__ import annotations

import atexit
import pickle
import shutil
import tempfile
import uuid
from contextlib import contextmanager

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; only a local session may fall back to a folder of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="glyphmill-")
    atexit.register(shutil.rmtree, folder, True)
    spark.conf.set("spark.checkpoint.dir", "file://" + folder)
    return "file://" + folder


@contextmanager
def _conf(spark: SparkSession, values: dict[str, str]):
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class Shared:
    """A broadcast value whose classes travel by value, so workers need no copy of the package."""

    def __init__(self, spark: SparkSession, value):
        self._sent, self._have = spark.sparkContext.broadcast(cloudpickle.dumps(value)), None

    def __getstate__(self):
        return {"_sent": self._sent, "_have": None}

    @property
    def value(self):
        if self._have is None:
            self._have = pickle.loads(self._sent.value)
        return self._have


def delete(spark: SparkSession, folder: str, at_end: bool = False) -> None:
    """Deletes a folder of the shared file system, now or when the session's JVM ends."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.deleteOnExit(path) if at_end else files.delete(path, True)


class Scratch:
    """Named working tables of one operator run; what isn't dropped before goes when the session ends."""

    def __init__(self, spark: SparkSession):
        self.spark, self._marked = spark, False
        self.root = f"{shared_folder(spark)}/{uuid.uuid4().hex}"

    def table(self, df: DataFrame, name: str, records: int = 1000) -> DataFrame:
        """Written and read again; `records` bounds the rows of an Arrow batch, for rows that are large."""
        path = f"{self.root}/{name}"
        with _conf(self.spark, {CLEANUP: "true", "spark.sql.parquet.compression.codec": "zstd", "spark.sql.execution.arrow.maxRecordsPerBatch": str(records)}):
            df.write.mode("overwrite").parquet(path)
        if not self._marked:  # a folder can be marked once it is there
            delete(self.spark, self.root, at_end=True)
            self._marked = True
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            delete(self.spark, f"{self.root}/{name}")


def parallel(df: DataFrame, at_least: int | None = None) -> DataFrame:
    """Spread a table that came as fewer pieces than there are cores."""
    return df if df.rdd.getNumPartitions() >= (at_least or df.sparkSession.sparkContext.defaultParallelism) else df.repartition(at_least or df.sparkSession.sparkContext.defaultParallelism)


def slots(spark: SparkSession) -> int:
    """Tasks that surely run at the same time; one where executors come and go."""
    if spark.conf.get("spark.dynamicAllocation.enabled", "false") == "true":
        return 1
    context = spark.sparkContext._jsc.sc()
    return max(1, context.maxNumConcurrentTasks(context.resourceProfileManager().defaultResourceProfile()))
