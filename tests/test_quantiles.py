"""Quantiles by counting passes against numpy, and reducers that are no column functions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridmoments.operators import analysis as A
from gridmoments.operators import quantiles as Q

QS = [0.0, 0.005, 0.1, 1 / 3, 0.5, 0.9, 0.995, 1.0]


def samples():
    rng = np.random.default_rng(0)
    return {
        "normal": rng.standard_normal(700), "tiny and large": np.concatenate([10.0 ** rng.uniform(-300, 300, 300), [5e-324, 1e-323, 1.7e308, -1.7e308]]), "ties": np.repeat([1.0, 2.0, 7.0], [400, 3, 100]),
        "one": np.array([3.5]), "two": np.array([-1.0, 4.0]), "same": np.full(200, 0.1), "zeros": np.array([0.0, -0.0] * 60 + [1e-310]), "close": 1 + np.arange(300) * 2.0**-52,
        "holes": np.concatenate([rng.exponential(1, 50), [np.nan, np.inf, -np.inf]]), "none": np.array([np.nan]), None: np.arange(90.0),
    }


@pytest.mark.parametrize("bins, few", [(64, 8), (1 << 14, 1 << 20)])
def test_groups_against_numpy(spark, monkeypatch, bins, few):
    monkeypatch.setattr(Q, "BINS", bins)
    monkeypatch.setattr(Q, "FEW", few)
    rows = [(g, float(v), float(k)) for g, values in samples().items() for k, v in enumerate(values)] + [("nulls", None, 1.0)] * 3
    df = spark.createDataFrame(rows, "`a b` string, x double, _x double").coalesce(2)
    got = {r["a b"]: r for r in Q.exact_quantiles(df, ["a b"], "x", QS).collect()}
    assert len(got) == 12
    for name, values in samples().items():
        good = values[np.isfinite(values)]
        r = got[name]
        assert (r["rows"], r["n"]) == (len(values), len(good))
        if not len(good):
            assert r["q"] is None and r["least"] is None
            continue
        places = [q * (len(good) - 1) for q in QS]
        s = np.sort(good + 0.0)
        want = [s[math.floor(p)] + (s[math.ceil(p)] - s[math.floor(p)]) * (p - math.floor(p)) for p in places]
        assert r["q"] == pytest.approx(want, rel=1e-14, abs=0), name
    assert got["nulls"]["rows"] == 3 and got["nulls"]["q"] is None


def test_no_group_columns_and_no_rows(spark):
    df = spark.range(1001).select((F.col("id") * 0.5).alias("x"))
    assert Q.exact_quantiles(df, [], "x", [0.25, 0.5]).first()["q"] == [125.0, 250.0]
    empty = Q.exact_quantiles(df.where("false"), [], "x", [0.5]).first()
    assert empty["n"] == 0 and empty["q"] is None
    assert Q.exact_quantiles(df.where("false").withColumn("g", F.lit(1)), ["g"], "x", [0.5]).count() == 0
    with pytest.raises(ValueError):
        Q.exact_quantiles(df, [], "x", [1.5])


def test_one_group_of_all_rows_is_spread(spark, monkeypatch):
    """No task sorts more than FEW rows or BINS counts, and the plan holds no whole group."""
    monkeypatch.setattr(Q, "FEW", 1000)
    monkeypatch.setattr(Q, "BINS", 256)
    df = spark.range(200_000).select(F.lit("all").alias("g"), ((F.col("id") * 7919) % 200_000 / 7.0).alias("x"))
    out = Q.exact_quantiles(df, ["g"], "x", [0.1, 0.5, 0.9])
    assert out.first()["q"] == pytest.approx([q * 199_999 / 7 for q in (0.1, 0.5, 0.9)])
    plan = out._jdf.queryExecution().executedPlan().toString().lower()
    assert "percentile" not in plan and "median" not in plan and "collect_set" not in plan


def test_reducers(spark):
    df = spark.createDataFrame([("a", float(k)) for k in range(11)] + [("a", float("nan")), ("b", None), ("c", 2.0)], "g string, x double")
    got = {r["g"]: r["x_reduced"] for r in A.group_reduce(df, ["g"], "x", lambda v: v.max() - v.min()).collect()}
    assert got == {"a": 10.0, "b": None, "c": 0.0}
    assert {r["g"]: r["m"] for r in A.group_reduce(df, ["g"], "x", F.max, "m").collect()} == {"a": 10.0, "b": None, "c": 2.0}
    many = {r["g"]: (r["x_reduced"], r["y_reduced"]) for r in A.group_reduce_many(df.withColumn("y", F.col("x") * 2), ["g"], ["x", "y"]).collect()}
    assert many == {"a": (5.0, 10.0), "b": (None, None), "c": (2.0, 4.0)}
    assert {r["g"]: r["y_reduced"] for r in A.group_reduce_many(df.withColumn("y", F.col("x") * 2), ["g"], ["y"], np.ptp).collect()} == {"a": 20.0, "b": None, "c": 0.0}
