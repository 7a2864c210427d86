"""Queries take the edges of expressions from their SQL; the operators by themselves go by letters and numbers of all scripts."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from provenir.operators import detect

KEY = 'token = "6d2ca8cc795e02fe1cd4d42fcf2a" and key = "1cc70516e0d3cc4" '
TEXTS = [KEY + "mot " * 30, "En outre, il est là. De plus,ici. À retenir: cœur " * 9, "Furthermore, it is. Moreover,so we delve; sœur ur " * 9, "éce n'est pas seulement toi, 9ce n'est pas juste lui, " * 9, KEY + "the cat and the dog is of that " * 4, "x_u_y u2 ur7 lol lol " + "the cat is of that and " * 5, "fin cc cc mdr " + "les mots de la nuit et du jour " * 5, KEY + "lol tbh mdr jsp " + "the cat is of that and les mots de la nuit " * 5, None, ""]
QUERIES = ("signals_long", "signals_by_category", "top_signals", "origin_shares", "others_pooled", "quote_mode", "verdict_score", "verdict_distribution", "report_summaries", "style_counts")


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("casual")
    # ids whose markers hold no casual words
    spark.createDataFrame([(1000 * i + 8 + k * 10, t, lang) for i, t in enumerate(TEXTS) for k, lang in enumerate(("en", "fr"))], "doc_id long, text string, lang string").coalesce(1).write.parquet(str(at / "documents.parquet"))
    return str(at)


@pytest.mark.parametrize("name", QUERIES)
def test_equals_its_sql(spark, table, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{table}/documents.parquet/*.parquet')")
    got = sorted(map(repr, map(tuple, entry.queries()[name](spark, table).collect())))
    assert got == sorted(map(repr, con.execute(entry.oracle_sql()[name]).fetchall()))


def test_operators_go_by_letters_of_all_scripts(spark):
    t = spark.createDataFrame([("cœur sœur u",), ("8cc7 _u u_ u2 ur",), ("furthermore, we; xfurthermore,",)], "t string").withColumn("low", detect.folded(F.col("t")))
    p = detect.style_parts(F.col("t"), F.col("low"), F.lit(True))
    assert [tuple(r) for r in t.select(p["casual"], p["lexicon"]).collect()] == [(1, 0), (4, 0), (0, 1)]


def test_highlights_show_what_counts(spark, table):
    """Where casual words are a signal, those inside keys are not shown as such."""
    test_equals_its_sql(spark, table, "report_highlights")
    got = {(r.doc_id, r.start) for r in entry.queries()["report_highlights"](spark, table).collect() if r.id == "sty-casual"}
    assert {d for d, _ in got} >= {7008, 7018} and all(at >= len(KEY) for d, at in got if d in (7008, 7018))
