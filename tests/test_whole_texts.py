"""Texts beyond the limit of a report."""

from provenir.plans.analyze import MAX_ANALYSED, analyzed


def test_signals_behind_the_report_limit(spark):
    t = "plain words here. " * (MAX_ANALYSED // 18 + 10) + "oaicite:3 oaicite:4"
    d = spark.createDataFrame([(1, t)], "doc_id long, text string")
    ids = lambda **k: {s.id for s in analyzed(d, **k).first().signals if s.category == "artefact"}
    assert ids() and not ids(limit=MAX_ANALYSED)
