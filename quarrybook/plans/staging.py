"""Intermediate tables in the folder that all executors share.

Operators that read an intermediate result more than once, or whose partition
ids have to stay fixed, write it here.  The folder is the session's
``spark.checkpoint.dir``; a temporary folder is made only for a local master.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

Built = TypeVar("Built")
_local_root: dict[str, str] = {}
_kept: dict[tuple, object] = {}


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder; on a local master without one, a temporary folder."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_root:
        _local_root[app] = tempfile.mkdtemp(prefix="spark-quarrybook-")
    return "file://" + _local_root[app]


def built_once(spark: SparkSession, name: str, files: DataFrame, build: Callable[[], Built]) -> Built:
    """What ``build`` makes of ``files``, a table as read from files: once for an application, anew when a file is another one."""
    stamp = F.xxhash64("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time")
    seen = files.select(stamp.alias("h")).distinct().agg(F.count("*"), F.bit_xor("h")).first()
    key = (spark.sparkContext.applicationId, name, *sorted(files.inputFiles())[:1], *seen)
    if key not in _kept:
        _kept[key] = build()
    return _kept[key]


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where its files give fewer partitions; at size files give many, and nothing is shuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


class Staging:
    """Written intermediate tables of one operator call.

    Tables that the returned DataFrame still reads live until the application
    ends; :meth:`drop` removes the others as soon as they are of no more use.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/quarrybook/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex[:12]}"
        atexit.register(self._at_exit)

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` once and read it back: a cut lineage and fixed rows."""
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def measured(self, df: DataFrame, name: str, **measures: Column) -> tuple[DataFrame, dict]:
        """:meth:`table` and aggregates over its rows, taken while they are written, without a job of their own."""
        seen = Observation()
        table = self.table(df.observe(seen, *[c.alias(k) for k, c in measures.items()]), name)
        return table, seen.get

    def drop(self, *names: str) -> None:
        for name in names:
            self._delete(f"{self.root}/{name}")

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)

    def _at_exit(self) -> None:
        if self.spark.sparkContext._jsc is not None:
            self._delete(self.root)
