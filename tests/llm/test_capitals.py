"""Words in lower case of A-Z alone, and texts that are hit at every place."""

import random
import time

from pyspark.sql import functions as F

from provenir.llm import decontaminate


def test_exact_words_of_every_letter(spark):
    chars = spark.createDataFrame([(f"aB{chr(c)} c{chr(c)}",) for c in range(1, 0x20000) if not 0xD800 <= c < 0xE000], "c string")
    x = chars.select("c", decontaminate._exact_words(F.col("c"), decontaminate._rough_words(F.col("c"))).alias("got"), F.regexp_extract_all(F.translate("c", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(decontaminate.WORD), 0).alias("want"))
    assert x.where("got <> want").count() == 0


def test_texts_hit_everywhere_take_seconds(spark):
    r = random.Random(1)
    for first in ("", "Éa "):
        item = " ".join("".join(r.choice("abcdeé") for _ in range(5)) for _ in range(20_000))
        docs = spark.createDataFrame([(1, first + item.upper().replace("É", "é")), (2, item.replace("é", "É"))], "doc_id long, text string")
        began = time.time()
        got = {x.doc_id: (x.n_words, x.n_hit) for x in decontaminate.report(docs, spark.createDataFrame([("i", item)], "item_id string, text string")).collect()}
        assert got[1] == (20_000 + (first != ""), 20_000) and got[2][1] < 10_000
        assert time.time() - began < 60
