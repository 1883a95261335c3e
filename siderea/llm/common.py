"""Helpers shared by the corpus operators: reading tables, row keys, written intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What splits words in every operator here: runs of anything but space and the ASCII controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
#: ASCII white space as bytes, for bytes.strip and bytes.translate.
SPACE = b" \t\n\x0b\x0c\r"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tune(spark: SparkSession, batch_bytes: int = 4 << 20) -> SparkSession:
    """Small Arrow batches, as one text may be megabytes long and a Python worker has a few hundred megabytes."""
    for key, value in (("spark.sql.execution.arrow.maxRecordsPerBatch", "5000"), ("spark.sql.execution.arrow.maxBytesPerBatch", str(batch_bytes))):
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir. Where that is unset a local session gets a temporary one;
    a cluster has no such folder, so there it is an error."""
    sc = spark.sparkContext
    base = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors see")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="siderea-"))
        base = sc.getCheckpointDir()
    return base


def save(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder as Parquet and read it again: this cuts lineage, and a lost executor costs no recomputation.

    The path is new on each call; a file system that lists lazily never sees an older table. Nothing reads a success marker, so none is
    written.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def row_key(*cols: str) -> list[Column]:
    """Two longs that stand for a row's id and text: 128 bits, never null. Rows equal in all of cols share them."""
    return [F.xxhash64(F.lit(1), *cols).alias("k1"), F.xxhash64(F.lit(2), *cols[::-1]).alias("k2")]


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like these that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n = f"_{n}"
        taken.add(n.lower())
        out.append(n)
    return out


def one_row_per_id(df: DataFrame, id_col: str) -> DataFrame:
    """Rows that repeat an id become the one with the least other columns; used where the id is a key, as in a table of labels."""
    rest = [c for c in df.columns if c != id_col]
    return df.groupBy(id_col).agg(F.min(F.struct(*rest)).alias("_r")).select(id_col, *[F.col("_r")[c].alias(c) for c in rest])
