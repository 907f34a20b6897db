"""Tables in the cluster's shared folder (``spark.checkpoint.dir``): how these operators cut lineage."""

from __future__ import annotations

import gc
import pickle
import uuid

from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

#: Bits of a sieve: it takes 4 MB whatever it holds.
SIEVE_BITS = 2**25


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back.

    The written table survives the loss of any executor, and unlike a checkpoint of rows
    it is compressed and lets later steps read single columns.
    """
    return _written(df, shared_path(df.sparkSession, label))


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shared(spark: SparkSession, thing) -> Broadcast:
    """``thing`` broadcast as bytes that hold its classes by value, so workers need not have this
    package; read it with :func:`opened`, once a task."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(thing))


def opened(sent: Broadcast):
    return pickle.loads(sent.value)


class Workspace:
    """Tables that are only needed until a result is stored; gone with :meth:`close`."""

    def __init__(self, spark: SparkSession, label: str) -> None:
        self.spark, self.path, self.n = spark, shared_path(spark, label), 0

    def stored(self, df: DataFrame, label: str) -> DataFrame:
        self.n += 1
        return _written(df, f"{self.path}/{self.n}-{label}")

    def drop(self, table: DataFrame) -> None:
        """Delete a table of this workspace; nothing may read it any more."""
        for path in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            self._delete(path)

    def release(self) -> None:
        """Let Spark delete the shuffle files of jobs that nothing refers to any more."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def close(self) -> None:
        self._delete(self.path)
        self.release()

    def _delete(self, path: str) -> None:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def sieve(keys: DataFrame, column: str) -> DataFrame:
    """A bitmap of the values of ``column``, for :func:`sifted`: at most 1024 rows of 4 KB."""
    h = F.pmod(F.xxhash64(column), F.lit(SIEVE_BITS))
    return keys.groupBy(F.shiftright(h, 15).alias("__bucket")).agg(F.bitmap_construct_agg(F.pmod(h, F.lit(32768))).alias("__bits"))


def sifted(df: DataFrame, key: Column, bitmap: DataFrame) -> DataFrame:
    """``df`` with ``__in``: false only where ``key`` is certainly not in the bitmap's table.

    It spares most rows a shuffle when few keys are wanted; an exact join must follow. The
    broadcast is the bitmap, 4 MB at most. Null keys may be either.
    """
    h = F.pmod(F.xxhash64(key), F.lit(SIEVE_BITS))
    met = df.withColumn("__h", h).join(F.broadcast(bitmap), F.shiftright("__h", 15) == F.col("__bucket"), "left")
    place = F.pmod("__h", F.lit(32768)).cast("int")
    byte = F.conv(F.hex(F.expr("substring(__bits, cast(__place div 8 as int) + 1, 1)")), 16, 10).cast("int")
    bit = F.expr("shiftright(__byte, __place % 8) & 1") == 1
    return met.withColumn("__place", place).withColumn("__byte", byte).withColumn("__in", F.coalesce(bit, F.lit(False))).drop("__h", "__bucket", "__bits", "__place", "__byte")
