"""Intermediate tables that several parts of a plan read: written once in the folder that the cluster shares."""

from __future__ import annotations

import atexit
import math
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes, as JSON, of a table that is broadcast whole, at most.
BROADCAST_BYTES = 16 << 20


def workspace(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, or in the warehouse where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_motioncheck"
    return f"{root.rstrip('/')}/motion-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """df as a written table: lost executors read it again. It is deleted when the application ends."""
    spark, path = df.sparkSession, workspace(df.sparkSession)
    df.write.parquet(path)

    def drop() -> None:
        try:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session may be gone, and its folder with it
            return

    atexit.register(drop)
    return spark.read.schema(df.schema).parquet(path)


def with_all(rows: DataFrame, shared: DataFrame) -> DataFrame:
    """Each of rows with each row of a table that all of them share.

    The table's size is measured: up to BROADCAST_BYTES it is broadcast. A larger one, of any
    size, is written in blocks of about half of that, which are broadcast one by one.
    """
    size = shared.agg(F.sum(F.octet_length(F.to_json(F.struct("*")))).alias("n")).first().n or 0
    if size <= BROADCAST_BYTES:
        return rows.join(F.broadcast(shared))
    blocks = math.ceil(2 * size / BROADCAST_BYTES)
    dealt = stored(shared.withColumn("_block", F.pmod(F.monotonically_increasing_id(), F.lit(blocks))))
    return reduce(DataFrame.union, (rows.join(F.broadcast(dealt.where(F.col("_block") == i).drop("_block"))) for i in range(blocks)))
