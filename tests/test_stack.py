"""Golden numbers of small stacks."""

import pytest

from siderea.model import Rejection
from siderea.operators import stack as S


def run(spark, values, method="mean", rejection=Rejection(), dq=None, weights=None, pixels=4):
    rows = [(p, i, v, (weights or [1] * len(values))[i], (dq or [0] * len(values))[i]) for p in range(pixels) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "px int, frame int, v long, w long, dq int")
    return S.stack(df, ["px"], method, rejection, weight="w", dq="dq").collect(), df


def test_sigma_keeps_what_winsorized_rejects(spark):
    r, _ = run(spark, [100, 100, 100, 1200], rejection=Rejection("sigma", 2.4, 2.4))
    assert {(x.master, x.n_high) for x in r} == {(375.0, 0)}
    r, _ = run(spark, [100, 100, 100, 1200], rejection=Rejection("winsorized_sigma", 2.4, 2.4))
    assert {(x.master, x.n_high, x.coverage) for x in r} == {(100.0, 1, 3)}


def test_minmax(spark):
    r, _ = run(spark, [1, 2, 3, 100], rejection=Rejection("minmax", min_samples=2))
    assert {(x.master, x.coverage, x.n_low, x.n_high) for x in r} == {(2.5, 2, 1, 1)}


def test_high_outlier(spark):
    for m in ("sigma", "winsorized_sigma"):
        r, _ = run(spark, [1, 1, 1, 1, 100], rejection=Rejection(m, 3, 1), pixels=30)
        assert {x.master for x in r} == {1.0} and sum(x.n_high for x in r) == 30


def test_invalid_is_not_rejected(spark):
    rows = [(p, i, None if (p, i) == (0, 0) else v, 4 if (p, i) == (1, 1) else 0) for p in range(4) for i, v in enumerate([1, 1, 1, 1, 100])]
    df = spark.createDataFrame(rows, "px int, frame int, v long, dq int")
    c = S.closure(S.reject(df, ["px"], Rejection("sigma", 3, 1), dq="dq")).collect()[0]
    assert (c.input_samples, c.valid_before, c.invalid, c.valid_after, c.high_rejected, c.closed) == (20, 18, 2, 14, 4, True)


def test_guard_is_all_or_nothing(spark):
    r, _ = run(spark, [1, 1, 50, 100], rejection=Rejection("minmax", min_samples=2))  # three of four would go
    assert {(x.coverage, x.n_low + x.n_high) for x in r} == {(4, 0)}


def test_empty_pixel_weights_and_unknown(spark):
    r, _ = run(spark, [5, 5], dq=[1, 1])
    assert {(x.master, x.coverage, x.variance, x.dq) for x in r} == {(0.0, 0, 0.0, 1)}
    r, _ = run(spark, [10, 20], "weighted_mean", weights=[3, 1])
    assert {x.master for x in r} == {12.5}
    r, _ = run(spark, [10, 20], "weighted_mean", weights=[0, 0])
    assert {x.master for x in r} == {0.0}
    with pytest.raises(ValueError):
        run(spark, [1], "drizzle")
    with pytest.raises(ValueError):
        run(spark, [1], rejection=Rejection("nope"))


def test_percentile_of_equal_values_rejects_nothing(spark):
    r, _ = run(spark, [7] * 6, rejection=Rejection("percentile", 10, 90))
    assert {(x.master, x.coverage) for x in r} == {(7.0, 6)}


def test_replay_sorts_samples_once(spark, tmp_path):
    """Counting a tile's pixels takes no second sort of the samples and no window by tile; partitions grow with the input."""
    from siderea.operators import replay

    rows = [(p, p % 2, f, p * 10 + f, 1 + f) for p in range(6) for f in range(4)] + [(6, 1, 9, 5, 1)]
    s = spark.createDataFrame(rows, "px long, tile long, frame long, v long, w long")
    d = replay.frame_contribution(replay.two_pass(s, ["px"], "sigma_clip", 9, 9), ["px"], ["tile"], "frame")
    plan = d._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number" not in plan and "windowspecdefinition(tile" not in plan
    got = {(r.tile, r.frame): r.contribution for r in d.collect()}
    for tile, pixels in ((0, [0, 2, 4]), (1, [1, 3, 5, 6])):
        for f in range(4):
            # of weights 1, 2, 3, 4 the mean lies at 2 beyond the first
            assert abs(got[tile, f] - sum((f - 2) * (1 + f) / 10 for p in pixels if p < 6) / len(pixels)) < 1e-9
    s.write.parquet(f"{tmp_path}/s")
    big = spark.read.parquet(f"{tmp_path}/s")
    assert S.dealt(big, ["px"], 16).rdd.getNumPartitions() > int(spark.conf.get("spark.sql.shuffle.partitions"))
