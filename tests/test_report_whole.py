"""The whole report in one call equals what its parts say by themselves."""

from pyspark.sql import functions as F

from provenir.functions import clean
from provenir.operators import explain
from provenir.plans.analyze import analyzed
from provenir.plans.report import report

TEXTS = ["It is crucial to delve into this robust realm — truly — contentReference[oaicite:3]{index=3} a vibrant tapestry. " * 3, "Plain words.", "", None, "x​y ​ see https://a.example/?utm_source=chatgpt.com&x=1"]


def test_texts(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = {r.doc_id: r for r in report(df).collect()}
    parts = analyzed(df)
    marks = {r.doc_id: r.highlights for r in explain.highlighted(explain.explained(parts, "doc_id"), "doc_id").collect()}
    plain = {r.doc_id: r for r in clean.cleaned(df).collect()}
    assert set(got) == set(range(5))
    for r in parts.collect():
        g = got[r.doc_id]
        assert (g.score, g.verdict, g.summary, g.confidence) == (r.score, r.verdict, r.summary, r.confidence)
        assert [s.id for s in g.signals] == [s.id for s in r.signals] and list(g.highlights) == list(marks.get(r.doc_id, []))
        assert (g.cleaned.text if g.cleaned else None) == (plain[r.doc_id].clean_text if plain[r.doc_id].removed else None)
        assert all(0 <= h.start < h.end <= len(g.text) for h in g.highlights) and len(g.vendors) >= 10
    first = {s.id: s.evidence for s in got[0].signals}
    assert "oaicite" in first["art-oaicite"][0] and got[0].vendors[0].vendor == "chatgpt" and got[0].vendors[0].reasons == ["art-oaicite"]
    assert got[0].origins[0].kind == "ia" and got[4].cleaned.removed >= 3 and got[2].text == "" and got[3].stats.words == 0


def test_files(spark):
    pdf = {"pdf.producer": "ReportLab PDF Library", "pdf.author": "(anonymous)", "pdf.creationdate": "D:20250301101500+00'00'"}
    rows = [(1, "Some words of a page.", "pdf", "pdf", pdf), (2, "# Step 1: read\nx = 1\n# Step 2: write\nopen('path/to/your/file')\n", "code", "py", {})]
    df = spark.createDataFrame(rows, "doc_id long, text string, kind string, extension string, raw map<string,string>")
    got = {r.doc_id: r for r in report(df, kind=F.col("kind"), raw="raw", extension="extension").collect()}
    assert any(m.flagged and m.key.startswith("Producteur") for m in got[1].metadata) and any(o.kind == "logiciel" for o in got[1].origins)
    assert {v.vendor for v in got[1].vendors} >= {"script"} and any(s.category == "metadata" for s in got[1].signals)
    code = {s.id: s.evidence for s in got[2].signals}
    assert code["code-steps"] and code["code-placeholders"][0] and {h.id for h in got[2].highlights} >= {"code-steps", "code-placeholders"}
    assert got[2].text[got[2].highlights[0].start : got[2].highlights[0].end].startswith("# Step 1")
