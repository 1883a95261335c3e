"""A corpus pipeline: quality, repeated lines, near-duplicates, benchmark leaks, and the mix of what is left.

Each stage takes (spark, docs, sf_dir), works on all rows of docs, and returns a DataFrame, which run() writes as Parquet and reads
again. All but the last return the columns of documents; rows that share a doc_id are kept or dropped by their own text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siderea.llm import cube_mixing, line_dedup, lsa_leaks, nbsvm, simhash_wide
from siderea.llm.common import fresh, read_table, row_key, save


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for good ones; null and empty texts are scored as any other."""
    model = nbsvm.fit(docs, read_table(spark, sf_dir, "labels"), ~nbsvm.held_out())
    return docs.filter(nbsvm.score_column(spark, model)(F.col("text")) >= nbsvm.THRESHOLD)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that at least three documents hold, but in the largest doc_id; n_chars follows the text. A text that
    loses nothing stays as it is, null included; documents stay even if all their lines go."""
    k1, k2, keep, text = fresh(docs, "k1", "k2", "keep", "stays")
    found = line_dedup.bitmaps(docs).select(F.col("k1").alias(k1), F.col("k2").alias(k2), F.col("keep").alias(keep))
    key = row_key("doc_id", "text")
    joined = docs.withColumns({k1: key[0], k2: key[1]}).join(found, [k1, k2], "left")
    changed = joined.withColumn(text, F.when(F.col(keep).isNotNull(), line_dedup.kept_text("text", keep)))
    kind = docs.schema["n_chars"].dataType
    new = {"text": F.when(F.col(keep).isNotNull(), F.col(text)).otherwise(F.col("text")), "n_chars": F.when(F.col(keep).isNotNull(), F.length(text).cast(kind)).otherwise(F.col("n_chars"))}
    return changed.withColumns(new).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8): the one with the smallest doc_id (null is
    larger than any; of equal ids, one). Documents without words resemble nothing and all stay."""
    k1, k2, lost = fresh(docs, "k1", "k2", "lost")
    key = row_key("doc_id", "text")
    named = save(simhash_wide.groups(docs.select("doc_id", "text", key[0].alias("k1"), key[1].alias("k2"))), "near")
    least = named.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "k1", "k2")).alias("least"), F.count("*").alias("rows")).filter("rows > 1")
    # rows of a group: those that aren't the least go; equal rows of the least are told apart below
    of_groups = named.join(least, "component").withColumn(lost, (F.col("k1") != F.col("least.k1")) | (F.col("k2") != F.col("least.k2"))).select(F.col("k1").alias(k1), F.col("k2").alias(k2), lost).distinct()
    keyed = docs.withColumns({k1: key[0], k2: key[1]}).join(of_groups, [k1, k2], "left").filter(~F.coalesce(F.col(lost), F.lit(False)))
    if named.groupBy("k1", "k2").count().filter("count > 1").isEmpty():
        return keyed.select(*docs.columns)
    alone = keyed.filter(F.col(lost).isNull()).select(*docs.columns)
    kept = keyed.filter(F.col(lost).isNotNull()).dropDuplicates([k1, k2]).select(*docs.columns)
    return alone.unionByName(kept)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    k1, k2 = fresh(docs, "k1", "k2")
    key = row_key("doc_id", "text")
    keyed = docs.withColumns({k1: key[0], k2: key[1]})
    named = docs.select(F.struct(key[0].alias("k1"), key[1].alias("k2")).alias("doc_id"), "text")
    found = lsa_leaks.leaks(named, read_table(spark, sf_dir, "benchmark")).select(F.col("doc_id.k1").alias(k1), F.col("doc_id.k2").alias(k2)).distinct()
    return keyed.join(found, [k1, k2], "left_anti").select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many times the mix takes each document."""
    return cube_mixing.mix(docs)


STAGES = [
    ("quality", quality),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("leaks", leaks),
    ("mixture", mixture),
]

#: No SQL expresses the stages (a learned classifier, SimHash, latent retrieval, sampling); tests hold each against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = save(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
