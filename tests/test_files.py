"""Readers and file detectors on files built here; calibration, report tables and streams on small tables."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from provenir.operators import calibrate, files, likelihood
from provenir.sources import readers, store
from provenir.streaming import stream

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def zipped(parts):
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        for n, t in parts.items():
            z.writestr(n, t)
    return held.getvalue()


def docx(creator="python-docx", app=None):
    core = f'<c xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:creator>{creator}</dc:creator></c>'
    parts = {"word/document.xml": f"<w:document {W}><w:body><w:p><w:r><w:t>Hello</w:t></w:r></w:p><w:p><w:r><w:t>World</w:t></w:r></w:p></w:body></w:document>", "docProps/core.xml": core}
    return zipped(parts | ({"docProps/app.xml": f"<a><Application>{app}</Application></a>"} if app else {}))


@pytest.fixture(scope="module")
def read(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("files")
    pdf = b"%PDF-1.4\n% ReportLab Generated PDF\n/Producer (ReportLab) /Author (anonymous) /Title (untitled) /CreationDate (D:20240101120000+00'00') /URI (https://a.b/c)"
    made = {"a.docx": docx(), "b.docx": docx("Ann", "Microsoft Office Word"), "c.pdf": pdf, "d.txt": b"one\r\ntwo\r\n", "e.txt": "été".encode("cp1252"), "f.bin": bytes(range(20)) * 9, "g.doc": b"x", "h.txt": b"  ", "i.docx": b"PK broken", "p.zip": zipped({"CLAUDE.md": "# rules", "src/a.py": "x = 1\n", "node_modules/b.js": "1", ".aider.chat.history.md": "log"})}
    for n, b in made.items():
        (top / n).write_bytes(b)
    return {r.filename: r for r in readers.documents_in(spark, str(top)).collect()}, readers.documents_in(spark, str(top)).cache()


def test_readers(read):
    rows, _ = read
    assert rows["a.docx"].text == "Hello\n\nWorld" and rows["a.docx"].raw["docx.creator"] == "python-docx" and rows["a.docx"].raw["docx.hasapp"] == "0"
    assert rows["c.pdf"].raw["pdf.producer"] == "ReportLab" and rows["c.pdf"].urls == ["https://a.b/c"] and rows["c.pdf"].kind == "pdf"
    assert rows["d.txt"].text == "one\ntwo\n" and rows["d.txt"].raw["file.lineendings"] == "CRLF" and rows["e.txt"].text == "été"
    assert "src/a.py" in rows["p.zip"].text and "node_modules" not in rows["p.zip"].text
    assert all(rows[n].error for n in ("f.bin", "g.doc", "h.txt", "i.docx"))


def test_file_detectors(read):
    _, df = read
    found = df.where("error is null").select("filename", files.metadata(F.col("raw"), F.col("kind"), F.lit(300)).alias("m"), files.project(F.split(F.coalesce(F.try_element_at("raw", F.lit("project.paths")), F.lit("")), "\n"), F.lit(None).cast("array<string>")).alias("p"))
    got = {r.filename: ([s.id for s in r.m], [s.id for s in r.p]) for r in found.collect()}
    assert "meta-docx-lib" in got["a.docx"][0] and "meta-docx-noapp" in got["a.docx"][0] and "meta-docx-lib" not in got["b.docx"][0]
    assert {"meta-pdf-generator", "meta-pdf-defaults", "meta-pdf-utc"} <= {*got["c.pdf"][0]} and got["d.txt"][0] == []
    assert got["p.zip"][1] == ["project-assistant-transcript", "project-assistant-files", "project-git-missing"]


def test_metadata_names(spark):
    rows = [("pdf", {"pdf.producer": "ChatGPT"}), ("pdf", {"pdf.author": "Claude Monet"}), ("pdf", {"pdf.author": "Claude"}), ("pdf", {"pdf.title": "A word about gemini"}), ("txt", {"pdf.producer": "ChatGPT"})]
    got = [[(s.id, s.points) for s in r.m if s.id == "meta-ai-name"] for r in spark.createDataFrame(rows, "kind string, raw map<string,string>").select(files.metadata(F.col("raw"), F.col("kind"), F.lit(1)).alias("m")).collect()]
    assert got == [[("meta-ai-name", 40)], [], [("meta-ai-name", 40)], [("meta-ai-name", 12)], []]


def test_commits(spark):
    rows = [(["A <a@b>\nfix\n\nCo-Authored-By: Claude <x>"],), (["A <a@b>\nfix"],), ([],)]
    got = [[s.id for s in r.p] for r in spark.createDataFrame(rows, "c array<string>").select(files.project(F.array().cast("array<string>"), F.col("c")).alias("p")).collect()]
    assert got == [["project-git-assistant"], ["project-git-clean"], ["project-git-clean"]]


def test_token_measures_by_hand(spark):
    rows = [(1, 0, 7, 2.0, [(7, 0.0), (8, -1.0)]), (1, 1, 9, 2.0, [(7, 0.0)])]
    d = spark.createDataFrame(rows, "doc_id long, pos int, actual long, total_weight double, logits array<struct<token:long,logit:double>>")
    r = likelihood.position_stats(d, 10).collect()
    assert len(r) == 1 and r[0].log_prob == pytest.approx(-0.6931471805599453)
    import math

    p = [0.5, 0.5 * math.exp(-1)]
    lp = [math.log(x) for x in p] + [math.log((1 - sum(p)) / 8)]
    p.append(1 - sum(p))
    assert r[0].mean == pytest.approx(sum(a * b for a, b in zip(p, lp, strict=True))) and r[0].variance == pytest.approx(sum(a * b * b for a, b in zip(p, lp, strict=True)) - r[0].mean ** 2)
    x = likelihood.cross_entropy(d, d.withColumn("logits", F.slice("logits", 1, 1)), "doc_id").orderBy("pos").collect()
    assert x[0].x_ppl is None and x[1].x_ppl == pytest.approx(math.log(2))


def test_buckets_and_offsets(spark):
    got = [r.b for r in spark.createDataFrame([(t,) for t in (5, 40, 41, 65, 66, 100, 101, 160, 161, 900)], "t long").select(likelihood.bucket(F.col("t")).alias("b")).collect()]
    assert got == [30, 30, 50, 50, 80, 80, 120, 120, 200, 200]
    t = ((30, 1.0), (120, 3.0))
    assert [round(r.o, 6) for r in spark.createDataFrame([(10,), (60,), (500,)], "t long").select(likelihood.offset_at(t, F.col("t")).alias("o")).collect()] == [1.0, 2.0, 3.0]


def test_calibration(spark):
    assert sorted(calibrate.seeded_order(list(range(50)))) == list(range(50)) and calibrate.seeded_order([1, 2, 3, 4, 5, 6]) != [1, 2, 3, 4, 5, 6]
    rows = [(i, i, i % 2 == 0, 1, 60 + i, -2.0 - (0 if i % 2 else -0.8) - 0.01 * (i % 7), 2.0 + 0.01 * (i % 5), 0.1 * (i % 3), 1.0 - 0.2 * (i % 2 == 0) + 0.01 * (i % 9)) for i in range(60)]
    s = spark.createDataFrame(rows, "sample_id long, sample_group long, ai boolean, weight long, tokens long, mean_log_prob double, mean_entropy double, criterion double, binoculars double")
    w = calibrate.fitted(s)
    assert w.count() == 12
    scores = calibrate.out_of_fold(s, w).join(s.select("sample_id", "ai"), "sample_id").collect()
    assert sum((r.score > 0) == r.ai for r in scores) / len(scores) > 0.9


def test_store(spark, tmp_path):
    r = spark.createDataFrame([(f"{i:036x}", i) for i in range(250)], "report_id string, n int").withColumn("created", F.timestamp_seconds(F.col("n")))
    store.save(r, f"{tmp_path}/r")
    assert store.history(spark.read.parquet(f"{tmp_path}/r")).count() == 200 and store.find(spark, f"{tmp_path}/r", f"{3:036x}").first().n == 3 and store.find(spark, f"{tmp_path}/r", "../x").count() == 0
    assert store.without(r, r.limit(10)).count() == 240


def test_stream_equals_batch(spark, tmp_path):
    from provenir.plans.analyze import analyzed

    d = spark.createDataFrame([(1, "oaicite:3"), (2, "plain words here"), (3, None)], "doc_id long, text string")
    d.write.parquet(f"{tmp_path}/docs.parquet")
    key = lambda x: sorted(map(tuple, x.select("doc_id", "score", "verdict").collect()))
    assert key(stream.analyzed_stream(spark, f"{tmp_path}/docs.parquet", d.schema)) == key(analyzed(d))


def test_answers_of_batch(spark):
    t = "===== p01\n**" + "word " * 25 + "**\n===== p02\ntoo short\n"
    assert [(r.prompt_id, len(r.answer.split())) for r in readers.answers_of_batch(spark.createDataFrame([(t,)], "text string")).collect()] == [("p01", 25)]


def test_code_rules(spark):
    rows = [("# Here's the updated code\nx = 1", "py"), ("key = 'YOUR_API_KEY'", "py"), ("# Step 1\na\n# Step 2\nb", "py"), ("// this function a\n// let's b\n// now we c", "js"), ("print('✅ ok')\nprint('❌ no')", "py"), ("# a → b … c\nx", "py"), ("/* DOMAIN SERVICE — does things */\nx", "js"), ("x = '→ … —'", "py"), ("", "py")]
    got = [[s.id for s in r.c] for r in spark.createDataFrame(rows, "t string, e string").select(files.code(F.col("t"), F.col("e")).alias("c")).collect()]
    assert got == [["code-chat"], ["code-placeholders"], ["code-steps"], ["code-narration"], ["code-emoji-logs"], ["code-typography"], ["code-banner"], [], []]
