"""Helpers shared by the training-data operators: table access, shared intermediate tables, Arrow batch limits."""

from __future__ import annotations

import re
import tempfile
import uuid
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word separators of every contract here: space and the ASCII controls 0x09-0x0D, which are also what bytes.split() cuts at.
SPACES = "[\\x20\\x09-\\x0D]+"
#: Rows of an Arrow batch.  Documents can be long, so batches are cut by rows and, where Spark offers it, by bytes.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bound the Arrow batches that Python workers get."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster shares for intermediate data; a temporary one only where none is set and all runs in one process (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="spark-vireo-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: cuts lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/vireo-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, most: int = 500_000) -> DataFrame:
    """df, written, and broadcast if it has at most ``most`` (narrow) rows; beyond that Spark joins it by a shuffle."""
    df = cut(df)
    return F.broadcast(df) if df.count() <= most else df


#: Rows that may share a key before its rows are joined where they are.
HOT = 1000


def spread(rows: DataFrame, keyed: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """rows joined with keyed, which has at most one row a key, so that no task gets all rows of a frequent key.

    Keys that more than HOT rows share are at most one in HOT rows; they are looked up in a table that is broadcast if it is
    small, and the rows of other keys are shuffled.  rows is read several times, so it is best a written table.
    """
    often = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > HOT).select(key)
    hot = small(often.join(keyed, key, how))
    if hot.isEmpty():
        return rows.join(keyed, key, how)
    cold = rows.join(hot.select(key), key, "left_anti").join(keyed, key, how)
    return cold.unionByName(rows.join(hot, key))


def crc_mod(column: str, n: int):
    """crc32 of the id as text, modulo n (null ids count as the empty text)."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n


def crc_mod_py(doc_id, n: int) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % n
