"""Session helpers: shared scratch tables that cut lineage and survive lost executors."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_OWN_DIR: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as ``spark.checkpoint.dir`` names it.

    Where the session leaves it unset (tests, local runs) a folder of our own is made once
    per application; on a cluster the setting is expected to be there.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIR:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        _OWN_DIR[app] = "file://" + tempfile.mkdtemp(prefix="corpusloom-")
    return _OWN_DIR[app]


class Scratch:
    """Tables of one operator run, written under the shared folder.

    ``table`` materialises a frame and returns it read back, so later stages start from files
    instead of a long lineage; ``drop`` removes a table no later stage reads. As the frames an
    operator returns are lazy and still need theirs, what is left is removed by ``close``, at the
    end of a ``with`` block around the use of the result, or else when the application ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self._count = 0
        if not _LEFT:
            atexit.register(_delete_left)
        _LEFT[self.root] = spark

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def close(self) -> None:
        """Removes all tables; frames that read them can't be used any more."""
        if _LEFT.pop(self.root, None) is not None:
            _delete(self.spark, self.root)

    def counted(self, df: DataFrame) -> tuple[DataFrame, int]:
        """The written table and its number of rows, counted while writing.

        The count is taken in the writing stage itself, whose tasks add to it once each, however
        often one is done again.
        """
        seen = Observation()
        read = self.table(df.observe(seen, F.count(F.lit(1)).alias("n")))
        return read, seen.get["n"]

    def path(self) -> str:
        """A new path under the folder of this run."""
        self._count += 1
        return f"{self.root}/{self._count}"

    def table(self, df: DataFrame) -> DataFrame:
        path = self.path()
        df.write.parquet(path)
        read = self.spark.read.schema(df.schema).parquet(path)
        read._corpusloom_path = path
        return read

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            path = getattr(df, "_corpusloom_path", None)
            if path:
                _delete(self.spark, path)


#: Folders that are still there, to be removed when the application ends.
_LEFT: dict[str, SparkSession] = {}


def _delete_left() -> None:
    for root, spark in list(_LEFT.items()):
        _delete_quietly(spark, root)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _delete_quietly(spark: SparkSession, path: str) -> None:
    try:
        if spark.sparkContext._jsc is not None:
            _delete(spark, path)
    except Exception:  # the JVM may be gone already
        local = path.removeprefix("file://")
        if os.path.isdir(local):
            import shutil

            shutil.rmtree(local, ignore_errors=True)


def spread(df: DataFrame) -> DataFrame:
    """The frame in at least as many partitions as there are cores, for work that needs them.

    A large table has more partitions anyway and is left as it is; a small one in a single file
    would keep one core busy only. Only frames that come straight from a scan are looked at: the
    partitions of others are known when they run, and are chosen by adaptive execution.
    """
    node = df._jdf.queryExecution().sparkPlan()
    while node.children().size() == 1 and node.getClass().getSimpleName() in ("ProjectExec", "FilterExec", "ColumnarToRowExec"):
        node = node.children().apply(0)
    if node.children().size() or "Scan" not in node.getClass().getSimpleName():
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
