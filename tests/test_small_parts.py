"""Parts of readers, stores and the corpus that nothing else tests."""

import json

from pyspark.sql import functions as F

from provenir.operators import corpus
from provenir.sources import readers, store


def test_pasted_and_repaired(spark):
    r = readers.pasted(spark.createDataFrame([("a\r\nb\rcé",)], "text string")).first()
    assert (r.text, r.kind, r.size) == ("a\nb\ncé", "text", 7)
    name = spark.createDataFrame([("résumé.txt".encode().decode("latin-1"),)], "n string")
    assert name.select(readers.repaired_name(F.col("n"))).first()[0] == "résumé.txt"


def test_samples_there_and_back(spark, tmp_path):
    rows = [[0, 1, 40, -2.5, 2.0, 0.5, None], [1, 0, 90, -3.0, 2.1, -0.5, 1.1]]
    path = tmp_path / "samples.json"
    path.write_text(json.dumps({"columns": ["text", "ai", "tokens", "meanLogProb", "meanEntropy", "criterion", "binoculars"], "rows": rows}))
    samples = store.samples_from_json(spark, str(path))
    assert [(r.sample_group, r.ai, r.tokens, r.binoculars) for r in samples.orderBy("sample_id").collect()] == [(0, True, 40, None), (1, False, 90, 1.1)]
    out = corpus.exported(samples.withColumn("ai", F.col("ai").cast("int"))).orderBy("sample_id").collect()
    assert [json.loads(r.row) for r in out] == rows


def test_answers_of_a_batch_become_rows(spark):
    text = "intro\n===== p01 : x\n" + "word " * 25 + "\n===== p02 : y\nshort\n===== p03\n## Title\n" + "**bold** text " * 12
    answers = readers.answers_of_batch(spark.createDataFrame([(text,)], "text string"))
    got = {r.prompt_id: r.answer for r in answers.collect()}
    assert set(got) == {"p01", "p03"} and got["p03"].startswith("Title") and "*" not in got["p03"]
    asked = spark.createDataFrame([("p01", "wiki", "Topic", "neutre"), ("p03", "avis", "Other", None)], "prompt_id string, genre string, topic string, style string")
    rows = corpus.import_answers(answers, asked, "claude").orderBy("id").collect()
    assert [(r.id, r.label, r.genre, r.words, r.title) for r in rows] == [("ia-claude-p01", "ia", "wiki", 25, "Topic"), ("ia-claude-p03", "ia", "avis", 25, "Other")]


def test_reviews_that_fit(spark):
    df = spark.createDataFrame([(n, " ".join(["w"] * n)) for n in (39, 40, 400, 401)], "n int, text string")
    assert sorted(r.n for r in corpus.fit_reviews(df).collect()) == [40, 400]
