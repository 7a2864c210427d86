"""Calibration beyond what one task holds, and thresholds by score."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from provenir.operators import calibrate, likelihood


def test_fit_beyond_one_task(spark, monkeypatch):
    rows = [(i, i // 2, i % 3 == 0, 1 + i % 3, 60 + i, -2.0 - (0 if i % 3 else -0.4) - 0.05 * (i % 7), 2.0 + 0.01 * (i % 5), 0.1 * (i % 4), None if i % 9 == 0 else 1.0 + 0.01 * (i % 11)) for i in range(90)]
    s = spark.createDataFrame(rows, "sample_id long, sample_group long, ai boolean, weight long, tokens long, mean_log_prob double, mean_entropy double, criterion double, binoculars double")
    monkeypatch.setattr(calibrate, "ITERATIONS", 25)
    monkeypatch.setattr(calibrate, "MAX_LOCAL", 10)
    monkeypatch.setattr(calibrate, "folds", lambda _: pytest.fail("groups collected"))
    x = calibrate._replicated(s).toPandas()
    assert x.groupby("sample_id").fold.nunique().max() == 1 and set(x.fold) == set(range(5))
    w = {(r.formula, r.part): r for r in calibrate.fitted(s).collect()}
    assert len(w) == 12
    for (name, part), r in w.items():
        own = x[(x.formula == name) & (x.fold != part)]
        mean, sd, b, c = calibrate.fit(np.stack(own.x), own.ai.to_numpy(dtype=bool), own.weight.to_numpy())
        assert [r.bias, *r.mean, *r.sd, *r.weight] == pytest.approx([c, *mean, *sd, *b], abs=1e-9)


def test_thresholds_sum_by_score(spark):
    s = spark.range(4000).select(F.col("id").alias("sample_id"), F.lit(False).alias("ai"), (1 + F.col("id") % 3).alias("weight"), F.lit(60).alias("tokens"), (F.col("id") % 20 / 10.0).alias("score"))
    got = likelihood.thresholds_of(s)
    assert [tuple(r) for r in got.collect()] == [(50, 1.8)]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in plan[plan.index("Window") :]  # weights are added up before the running sum
