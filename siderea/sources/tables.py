"""The driver's Parquet tables as relations of the engine (see FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cents(col: str):
    return F.round(F.col(col) * 100).cast("bigint")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as a stack: pixel = part, frame = supplier, value = price in cents."""
    bits = F.when(F.col("l_discount") == 0.10, 2).otherwise(0).bitwiseOR(F.when((F.col("l_linestatus") == "O") & (F.col("l_tax") == 0), 4).otherwise(0))
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("px"), F.col("l_suppkey").alias("frame"), F.col("l_orderkey").alias("ord"), F.col("l_linenumber").alias("line"),
        cents("l_extendedprice").alias("v"), F.col("l_quantity").cast("bigint").alias("w"), F.col("l_returnflag").alias("filt"), bits.cast("int").alias("dq"),
    )


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as 8 x 8 images: frame = vector, value in millionths."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("frame"), F.col("label").alias("filt"), F.posexplode("embedding").alias("pos", "e"))
    return e.select("frame", "filt", F.expr("cast(pos div 8 as int)").alias("y"), F.expr("cast(pos % 8 as int)").alias("x"), F.round(F.col("e").cast("double") * 1000000).cast("bigint").alias("v"))


def whole_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same images in one row each: pixels is a list of (y, x, v). Nothing travels."""
    cell = lambda e, i: F.struct(F.floor(i / 8).cast("int").alias("y"), (i % 8).alias("x"), F.round(e.cast("double") * 1000000).cast("bigint").alias("v"))
    e = table(spark, sf_dir, "embeddings").filter(F.size("embedding") > 0)
    return e.select(F.col("vec_id").alias("frame"), F.col("label").alias("filt"), F.transform("embedding", cell).alias("pixels"))


#: The same relations for DuckDB, as common table expressions.
SAMPLES_SQL = """samples AS (SELECT l_partkey AS px, l_suppkey AS frame, l_orderkey AS ord, l_linenumber AS line, CAST(round(l_extendedprice * 100) AS BIGINT) AS v,
  CAST(l_quantity AS BIGINT) AS w, l_returnflag AS filt, (CASE WHEN l_discount = 0.10 THEN 2 ELSE 0 END) | (CASE WHEN l_linestatus = 'O' AND l_tax = 0 THEN 4 ELSE 0 END) AS dq FROM lineitem)"""
IMAGES_SQL = """images AS (SELECT frame, filt, CAST(p // 8 AS INTEGER) AS y, CAST(p % 8 AS INTEGER) AS x, CAST(round(CAST(e[p + 1] AS DOUBLE) * 1000000) AS BIGINT) AS v
  FROM (SELECT vec_id AS frame, label AS filt, embedding AS e, unnest(range(64)) AS p FROM embeddings))"""
