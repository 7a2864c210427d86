"""Lines and words of a text are made once, however many rules look at them: plans name each costly pattern once."""

from pyspark.sql import functions as F

from provenir import queries
from provenir.functions.text import is_prose, prose_sample, verse


def used(df, what: str) -> int:
    return df._jdf.queryExecution().optimizedPlan().toString().count(what)


def test_each_pattern_once(spark):
    d = spark.range(3).select(F.col("id").cast("string").alias("t"))
    assert used(d.select(is_prose(F.col("t")).alias("p")), "regexp_extract_all") == 1
    x = d.select(prose_sample(F.col("t")).alias("s"))
    assert used(x, "gguf") == 1 and used(x, "split(") == 1 and used(x, "regexp_extract_all") == 2  # words of a line, words of the sample
    assert used(d.select(verse(F.col("t")).alias("v")), "split(") == 1


def test_many_lines(spark, tmp_path):
    line = "Voici une phrase assez longue avec des mots simples"
    texts = ["\n".join([line] * 5000), "\n".join(["Rose du soir", "Chose du noir"] * 2000), f"Title\n{line}, et puis encore\n1 2 3\n\n" * 12, None, "", " \n\n  x "]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.sample_chars, r.prose_ratio) for r in queries.prose_sample(spark, str(tmp_path)).collect()}
    own = len(f"{line}, et puis encore")
    assert got[0] == (len(texts[0]), 1.0) and got[2] == (12 * own + 11 * 2, round((12 * own + 22) / len(texts[2]), 4))
    assert got[1] == (len(texts[1]), 0.0) and got[3][0] is None and got[4] == (0, 0.0) and got[5] == (len(texts[5]), 0.0)
    v = {r.doc_id: r.verse for r in queries.verse_flag(spark, str(tmp_path)).collect()}
    assert v[1] and not any(v[i] for i in (2, 3, 4, 5))
