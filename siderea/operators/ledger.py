"""Accounting: what became of each frame, and checks that artifacts agree."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Statuses of the stages a frame passes, in order.
STAGES = ("quality", "registration", "warp", "local_norm", "integration")


def ledger(stages: dict[str, DataFrame], key: str = "frame_id") -> DataFrame:
    """Full outer join of (frame_id, status) of each stage; a frame that a stage doesn't know is missing there."""
    named = [d.select(key, F.col("status").alias(n)) for n, d in stages.items()]
    out = reduce(lambda a, b: a.join(b, key, "full_outer"), named)
    return out.select(key, *[F.coalesce(n, F.lit("missing")).alias(n) for n in stages])


# Statuses that bar a frame from use, by stage.
BARRED = {"quality": ("rejected",), "registration": ("quality_rejected", "failed", "rejected", "missing", "excluded"), "warp": ("skipped", "missing"), "local_norm": ("empty", "skipped_zero_weight", "missing")}


def conflicts() -> Column:
    """Stages that barred a frame which was used all the same."""
    used = F.col("integration") == "used"
    return F.array_compact(F.array(*[F.when(used & F.col(s).isin(*bad), s) for s, bad in BARRED.items()]))


def final_status() -> Column:
    """Eight outcomes, whose names and order are fixed values."""
    q, r, w, n, i = (F.col(s) for s in STAGES)
    return (
        F.when((i == "used") & (F.size(conflicts()) > 0), "integration_conflict").when(i == "used", "integrated")
        .when((q == "rejected") | (r == "quality_rejected"), "quality_rejected").when(r.isin("failed", "rejected", "missing", "excluded"), "registration_rejected")
        .when(w == "skipped", "warp_skipped").when(n.isin("empty", "skipped_zero_weight"), "local_norm_rejected").when(i == "zero_weight", "zero_weight")
        .when(i != "missing", "not_integrated").otherwise("pending")
    )


def account(stages: dict[str, DataFrame], key: str = "frame_id") -> DataFrame:
    d = ledger(stages, key)
    return d.withColumns({"conflicts": conflicts(), "final_status": final_status()})


def exceptions(rows: DataFrame, ok: tuple[str, ...] = ("integrated",)) -> DataFrame:
    return rows.filter(~F.col("final_status").isin(*ok)).groupBy("final_status").agg(F.count("*").alias("n"))


def checks(row: DataFrame, tests: dict[str, Column]) -> DataFrame:
    """One row of facts to its checks: passed, and the names of those that failed."""
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), n) for n, c in tests.items()]))
    return row.select(F.lit(len(tests)).alias("checks"), (F.size(failed) == 0).alias("passed"), failed.alias("failed_checks"))


def duplicates(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1")


def changes(baseline: DataFrame, candidate: DataFrame, key: str, field: str) -> DataFrame:
    """Frames on one side alone or with another value."""
    b, c = baseline.select(key, F.col(field).alias("b")), candidate.select(key, F.col(field).alias("c"))
    d = b.withColumn("in_b", F.lit(True)).join(c.withColumn("in_c", F.lit(True)), key, "full_outer")
    kind = F.when(F.col("in_c").isNull(), "removed").when(F.col("in_b").isNull(), "added").when(~F.col("b").eqNullSafe(F.col("c")), "changed")
    return d.withColumn("change", kind).filter("change is not null").select(key, "b", "c", "change")
