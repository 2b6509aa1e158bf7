"""Tables in the folder that all executors share: a lineage ends there, and a lost executor costs a reread."""

from __future__ import annotations

import atexit
import contextlib
import gc
import tempfile
import time
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; one of our own only where that is unset and all is one process (tests)."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="matchloom-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read again. The files go when the interpreter ends."""
    rows = Growing(df.sparkSession, name)
    rows.add(df)
    return rows.read()


class Growing:
    """A table in the shared folder that is written in parts. Its files go when the interpreter ends."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.path, self.schema = spark, f"{folder(spark)}/matchloom-{name}-{uuid.uuid4().hex}", None
        _written.append((spark, self.path))

    def add(self, df: DataFrame) -> None:
        df.write.mode("append").parquet(self.path, compression="zstd")
        self.schema = df.schema

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)


@contextlib.contextmanager
def passing(*names: str) -> Iterator[None]:
    """Tables that are written within go at its end, but those of the names. Frames that still read the others must not outlive it."""
    before = len(_written)
    yield
    for spark, path in _written[before:]:
        if not path.rsplit("/", 1)[-1].startswith(tuple(f"matchloom-{n}-" for n in names)):
            _delete(spark, path)
            _written.remove((spark, path))


def release(spark: SparkSession) -> None:
    """Lets Spark drop shuffle files that no live DataFrame needs any more. A thread of py4j tells the JVM which of its objects
    Python has let go, once a second; before that the JVM would keep them. The last plan only goes in a second collection."""
    told = getattr(spark.sparkContext._gateway._gateway_client, "finalizer_deque", None)
    for _ in range(2):
        gc.collect()
        for _ in range(100):
            if not told:
                break
            time.sleep(0.05)
        time.sleep(0.2)  # the last one
        spark.sparkContext._jvm.System.gc()


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        with contextlib.suppress(Exception):  # the session may be gone; the folder is scratch space
            _delete(spark, path)
