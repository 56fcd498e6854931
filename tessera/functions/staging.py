"""Cutting lineage through files that all executors share, and sized broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows, and bytes about, of a side that may be broadcast; beyond either the join shuffles.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 48 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one where that is unset, as in local tests."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


class Stage:
    """Writes DataFrames as tables in the shared folder and reads them back.

    The rows survive the loss of any executor and the plan restarts at the
    files.  ``drop`` deletes a table that no later plan reads.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)  # plans may read it until the application ends

    def put(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._staged_at = path  # type: ignore[attr-defined]
        return out

    def drop(self, *tables: DataFrame | None) -> None:
        jvm = self.spark.sparkContext._jvm
        for df in tables:
            if df is not None and (path := getattr(df, "_staged_at", None)):
                at = jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def width(of: T.DataType) -> int:
    """Bytes that a value takes in a broadcast, about; texts are taken to be short and arrays to have eight members."""
    if isinstance(of, T.StructType):
        return 8 + sum(width(f.dataType) for f in of.fields)
    if isinstance(of, T.ArrayType):
        return 16 + 8 * width(of.elementType)
    if isinstance(of, T.MapType):
        return 16 + 8 * (width(of.keyType) + width(of.valueType))
    return {"string": 40, "binary": 256}.get(of.typeName(), 8)


def sized(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if its counted rows, by number and by width, are within the limits; else the join may shuffle."""
    return F.broadcast(df) if rows <= limit and rows * width(df.schema) <= BROADCAST_BYTES else df
