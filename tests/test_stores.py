"""Stores as an application uses them: retention, deletion, answers, apply, reset, and a status that is kept."""

import datetime

import pytest
from pyspark.sql import functions as F

from provenir.operators import calibrate, likelihood, recalibrate
from provenir.sources.reports import AnswerNotPossible, Calibrations, NotEnoughAnswers, Reports

SCHEMA = "report_id string, created timestamp, model_status string, model_domain string, model string, tokens long, mean_log_prob double, mean_entropy double, criterion double, binoculars double"


def rid(i):
    return f"{i:08x}-0000-0000-0000-000000000000"


def reports(spark, ids, **over):
    rows = []
    for i in ids:
        ai = i % 2 == 0
        r = {"report_id": rid(i), "created": datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=i), "model_status": "used", "model_domain": "prose", "model": "m", "tokens": 60 + i % 90, "mean_log_prob": -2.0 - 0.3 * (not ai) - i % 7 / 50, "mean_entropy": 2.1, "criterion": (1.0 if ai else -1.0) + i % 5 / 10, "binoculars": 0.9 + 0.2 * (not ai) + i % 3 / 100} | over
        rows.append(tuple(r.values()))
    return spark.createDataFrame(rows, SCHEMA)


def test_reports(spark, tmp_path):
    r = Reports(spark, str(tmp_path), SCHEMA, most=5)
    r.save(reports(spark, range(4)))
    r.save(reports(spark, range(3, 8), tokens=99))
    assert [x.report_id for x in r.history().collect()] == [rid(i) for i in (7, 6, 5, 4, 3)]
    assert r.find(rid(3)).first().tokens == 99 and r.find(rid(1)).first() is None and r.find("x' or '1'='1").first() is None
    r.delete(rid(5))
    r.delete("no id")
    assert [x.report_id for x in r.history().collect()] == [rid(i) for i in (7, 6, 4, 3)]
    r.clear()
    assert r.history().collect() == []


def test_answers(spark, tmp_path):
    r, c = Reports(spark, str(tmp_path / "r"), SCHEMA), Calibrations(spark, str(tmp_path / "c"))
    r.save(reports(spark, [1, 2]))
    r.save(reports(spark, [3], model_status="skipped").unionByName(reports(spark, [4], criterion=None)))
    assert c.set_answer(r, rid(1), "human", "claude")["vendor"] is None
    assert c.set_answer(r, rid(2), "ai", "claude")["vendor"] == "claude"
    c.set_answer(r, rid(2), "ai", None)
    assert c.answer(rid(2))["vendor"] is None and c.answers.read().count() == 2
    with pytest.raises(AnswerNotPossible, match="pas de mesure"):
        c.set_answer(r, rid(3), "ai")
    with pytest.raises(AnswerNotPossible, match="relancez"):
        c.set_answer(r, rid(4), "ai")
    with pytest.raises(AnswerNotPossible):
        c.set_answer(r, rid(77), "ai")
    assert c.set_answer(r, rid(1), None) is None and c.answer(rid(1)) is None


def test_calibration_is_applied_reset_and_kept(spark, tmp_path, monkeypatch):
    r, c = Reports(spark, str(tmp_path / "r"), SCHEMA), Calibrations(spark, str(tmp_path / "c"))
    base = reports(spark, range(1000, 1120)).select((F.substring("report_id", 1, 8)).alias("h"), "tokens", "mean_log_prob", "mean_entropy", "criterion", "binoculars").withColumn("sample_id", F.conv("h", 16, 10).cast("long"))
    c.samples.append(base.select("sample_id", F.col("sample_id").alias("sample_group"), (F.col("sample_id") % 2 == 0).alias("ai"), F.lit(1).alias("weight"), "tokens", "mean_log_prob", "mean_entropy", "criterion", "binoculars"))
    monkeypatch.setattr(calibrate, "ITERATIONS", 200)
    with pytest.raises(NotEnoughAnswers, match="20"):
        c.apply("m")
    one = reports(spark, range(30)).withColumn("label", F.when(F.col("tokens") % 2 == 0, "ai").otherwise("human"))
    c.answers.append(one.select("report_id", "label", F.when(F.col("label") == "ai", "claude").alias("vendor"), "tokens", "mean_log_prob", "mean_entropy", "criterion", "binoculars", F.lit("prose").alias("domain"), "model", F.col("created").alias("at")))
    fits = []
    fitted = calibrate.fitted
    monkeypatch.setattr(recalibrate.calibrate, "fitted", lambda s: fits.append(1) or fitted(s))
    first = c.status("m")
    assert len(fits) == 1 and first["answers"] == {"ai": 15, "human": 15, "unused": 0, "vendors": {"claude": 15}} and first["active"] == likelihood.DEFAULT
    p = first["proposal"]
    assert p["answers_used"] == 30 and p["proposed"]["correct"] >= 28 and p["calibration"]["texts"] == {"ai": 255, "human": 415} and p["calibration"]["answers"] == 30
    assert tuple(map(tuple, p["current"]["rates"])) == likelihood.DEFAULT["rates"]
    again = Calibrations(spark, str(tmp_path / "c"))
    assert again.status("m") == first and len(fits) == 1
    assert again.status("other")["proposal"] is None and again.status("other")["answers"]["unused"] == 30
    r.save(reports(spark, [31]))
    c.set_answer(r, rid(31), "human")
    before = len(fits)
    assert c.status("m")["proposal"]["answers_used"] == 31 and len(fits) == before + 1
    now = c.apply("m", datetime.datetime(2024, 5, 1))
    assert now["origin"] == "personnalisée" and now["applied_at"] == datetime.datetime(2024, 5, 1) and c.active() == now
    told = c.status("m")
    assert told["active"] == now and tuple(map(tuple, told["proposal"]["current"]["rates"])) == now["rates"]
    scored = likelihood.scored(c.samples.read(), now["measures"], now["binoculars"]).withColumn("right", (F.col("logit") > 0) == F.col("ai"))
    assert scored.where("right").count() > 60
    assert c.reset() == likelihood.DEFAULT == c.active()
