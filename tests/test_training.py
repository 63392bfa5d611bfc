"""Exact splits, and training on all rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridmoments.operators import sampling as S
from gridmoments.operators import training as L


def test_parts_have_exact_sizes(spark, monkeypatch):
    monkeypatch.setattr(S, "FEW", 3)
    df = spark.range(1000).select("id", (F.col("id") % 7).alias("g"))
    for n in (0, 1, 500, 999, 1000):
        a, b = S.split_exactly(df, n, ["id"])
        assert (a.count(), b.count()) == (n, 1000 - n) and a.unionByName(b).distinct().count() == 1000
    a, b = S.split_exactly(df.select("g"), 613)  # seven different rows only
    assert (a.count(), b.count()) == (613, 387)
    a, b = S.split_exactly(df.select(F.lit(1).alias("g")), 613)
    assert (a.count(), b.count()) == (613, 387)
    first, again, other = (sorted(r.id for r in S.sample_exactly(d, 100, ["id"], seed).collect()) for d, seed in ((df, 1), (df.repartition(5), 1), (df, 2)))
    assert first == again != other and len(first) == 100
    assert S.sample_exactly(df, 5000).count() == 1000
    with pytest.raises(ValueError):
        S.split_exactly(df, 1001)


@pytest.mark.parametrize("n, train", [(1, 1), (2, 1), (3, 2), (10, 8), (777, 621)])
def test_split_takes_the_floor(spark, n, train):
    a, b = L.split(spark.range(n), 0.8, ["id"])
    assert (a.count(), b.count()) == (train, n - train)


def table(spark, n, seed=0):
    x = np.random.default_rng(seed).standard_normal((n, 3))
    rows = [(float(a), float(b), float(c), float(max(a, 0)), float(np.sin(b) + c)) for a, b, c in x]
    return spark.createDataFrame(rows, "a double, b double, c double, q_liq double, s double")


def test_training_meets_all_rows_in_many_tasks(spark, monkeypatch):
    """Averaged tasks over ten times the rows end no worse than one task over a tenth."""
    few = L.train(table(spark, 500), ["a", "b", "c"], ["q_liq", "s"], hidden=(16,), epochs=8, batch=32, rate=1e-2)
    monkeypatch.setattr(L, "TASK_ROWS", 600)
    monkeypatch.setattr(L, "FAN", 2)
    monkeypatch.setattr(L.shared, "written", lambda df, name, keep=L.shared.written: keep(df.repartition(7), name) if name == "epoch" else keep(df, name))
    spark.conf.set("spark.sql.files.openCostInBytes", "128m")  # a task for each file
    try:
        many = L.train(table(spark, 5000), ["a", "b", "c"], ["q_liq", "s"], hidden=(16,), epochs=8, batch=32, rate=1e-2)
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert many["loss"] <= few["loss"] * 1.05 and many["losses"][0] > many["loss"] == min(many["losses"]) and many["skipped"] == 0


def test_batches_that_are_not_finite_are_skipped(spark, tmp_path):
    df = table(spark, 400).withColumn("s", F.when(F.col("a") > 2, 1e200).otherwise(F.col("s"))).withColumn("b", F.when(F.col("c") > 2, float("nan")).otherwise(F.col("b")))
    model = L.train(df, ["a", "b", "c"], ["s"], hidden=(4,), epochs=2, batch=8)
    assert model["skipped"] > 0 and all(np.isfinite(w).all() for w in L.Network.load(model["network"]).weights)
    L.save_run(df.where("not isnan(b)"), model, str(tmp_path / "run"))
    again = L.load_model(spark, str(tmp_path / "run"))
    assert again["network"] == model["network"]
    want = {r["a"]: r["pred_s"] for r in L.predict(df, model).collect()}
    assert all(want[r["a"]] == pytest.approx(r["pred_s"]) for r in spark.read.parquet(str(tmp_path / "run" / "predictions")).collect())
    assert spark.read.csv(str(tmp_path / "run" / "metrics"), header=True).columns == ["target", "mse", "rmse", "mae", "r2"]
    with pytest.raises(ValueError, match="no finite rows"):
        L.train(df.where("a is null"), ["a"], ["s"])


def test_sums_of_parts_are_those_of_all():
    rng = np.random.default_rng(1)
    mapping = L.output_mapping(["q_liq", "s"])
    out, y = rng.standard_normal((90, 3)), rng.standard_normal((90, 2))
    present = (y > 0).astype(float)
    parts = sum(L.loss_sums(out[k : k + 30], y[k : k + 30], present[k : k + 30], mapping) for k in (0, 30, 60))
    assert L.loss_of(parts) == pytest.approx(L.loss_and_gradient(out, y, present, mapping)[0])
    for k in range(3):
        for j in range(5):
            up = out.copy()
            up[j, k] += 1e-6
            step = (L.loss_and_gradient(up, y, present, mapping)[0] - L.loss_and_gradient(out, y, present, mapping)[0]) / 1e-6
            assert step == pytest.approx(L.loss_and_gradient(out, y, present, mapping)[1][j, k], abs=1e-5)
