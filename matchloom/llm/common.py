"""What the operators share: reading tables, cutting lineage in the shared folder."""

from __future__ import annotations

import atexit
import contextlib
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import shipping

#: Training rows of operators 5 and 8: crc32(doc_id as text) mod 3 is not 1.
FOLDS, HELD_OUT = 3, 1

_written: list[tuple[SparkSession, str]] = []
_tables: list[tuple[SparkSession, str]] = []


#: Rows of a batch that goes to Python, unless the session has its own number: texts are long.
BATCH_ROWS, _DEFAULT_ROWS = "1000", "10000"


def ship(spark: SparkSession) -> None:
    """Makes a session ready: its executors have this package, and batches of texts stay small."""
    shipping.ship(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, _DEFAULT_ROWS) == _DEFAULT_ROWS:
        spark.conf.set(key, BATCH_ROWS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; one of our own only where that is unset and all is one process (tests)."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="matchloom-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def materialize(df: DataFrame, name: str, packed: bool = False) -> DataFrame:
    """Write df to the shared folder and read it back: the lineage ends there, and a lost
    executor costs a reread. The files go when the interpreter ends. packed: its values are compressed already."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/matchloom-{name}-{uuid.uuid4().hex}"
    (df.write.option("compression", "uncompressed") if packed else df.write).parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def materialize_by(df: DataFrame, name: str, parts: int, by: str, kind: str) -> DataFrame:
    """As materialize(), as a table of `parts` buckets by one column in a folder for each value of
    another: a later grouping by that column needs no shuffle of these rows, whose values are compressed already. Buckets need a table; it leaves
    the catalog with its files, when the interpreter ends."""
    spark = df.sparkSession
    key = f"matchloom_{name}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{key}"
    df.write.format("parquet").option("compression", "uncompressed").partitionBy(kind).bucketBy(parts, by).option("path", path).saveAsTable(key)
    _written.append((spark, path))
    _tables.append((spark, key))
    return spark.table(key)


def spread(df: DataFrame) -> DataFrame:
    """df as a side of a join that is never broadcast. Spark estimates a side by the bytes of its files, as if an explode
    made no rows and a dictionary saved no space; such a side can be many times larger, and the driver would hold it."""
    return df.hint("merge")


def release(spark: SparkSession) -> None:
    """Let Spark drop shuffle files that no live DataFrame needs any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@atexit.register
def _clean() -> None:
    for spark, name in _tables:
        with contextlib.suppress(Exception):
            spark.sql(f"DROP TABLE IF EXISTS {name}")
    for spark, path in _written:
        with contextlib.suppress(Exception):  # the session may be gone; the folder is scratch space
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def held_out(col, folds: int = FOLDS, fold: int = HELD_OUT):
    """crc32(doc_id as text) mod folds equals fold; a null id counts as the empty text."""
    return (F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % folds) == fold
