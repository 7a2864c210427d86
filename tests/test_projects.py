"""Zipped projects: the budget against a plain reading, offsets, assistants' files, metadata rows, and places of code rules."""

import io
import random
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from provenir.operators import places
from provenir.sources import projects

FILES = {
    "app/src/b.py": "# Step 1: read\nx = 1\n# Step 2: write\nopen('path/to/your/file')\n", "app/src/a.ts": "// a → b, c ≠ d … and « more »\r\nconst k = 'YOUR_API_KEY_HERE';\r\n", "app/CLAUDE.md": "x", "app/src/.cursorrules": "y",
    "app/node_modules/x/CLAUDE.md": "z", "app/dist/AGENTS.md": "w", "app/dist/gone.js": "gone()", "app/x.min.js": "m", "app/empty.py": "  \n", "app/large.py": "x" * 70_000, "__MACOSX/app/src/b.py": "no", "app/readme.md": "text",
}


def zipped(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in files.items():
            z.writestr(name, text)
    return bytearray(out.getvalue())


def read(spark, archives):
    return projects.projects(spark.createDataFrame([(p, zipped(f) if isinstance(f, dict) else bytearray(f)) for p, f in archives.items()], "path string, content binary"))


def test_a_project(spark):
    out, own = read(spark, {"p": FILES, "none": {"a.txt": "x"}, "only": {"CLAUDE.md": "x"}, "broken": b"PK\x03\x04 no", "other": b"text"})
    got = {r.project: r for r in out.collect()}
    p = got["p"]
    assert [f.path for f in p.files] == ["app/src/a.ts", "app/src/b.py"] and p.source_files == 4 and "other" not in got
    for f in p.files:
        assert p.text[f.start : f.end] == FILES[f.path].replace("\r\n", "\n")
    assert p.assistant_files == ["app/CLAUDE.md", "app/dist/AGENTS.md", "app/src/.cursorrules"] and p.commits is None and p.git_error is None and p.error is None
    assert [tuple(m) for m in p.metadata] == [("Fichiers dans l'archive", "11"), ("Fichiers source analysés", "2 sur 4"), ("Fichiers source trop gros ignorés", "1"), ("Historique git", "absent (dossier .git non inclus)"), *(("Fichier d'assistant IA", f) for f in p.assistant_files)]
    assert got["none"].error == projects.NOTHING and got["only"].error is None and got["broken"].error == projects.BROKEN
    highlights, evidence = places.project_places(own)
    shown = {r.project: r.highlights for r in highlights.collect()}["p"]
    assert {(h.id, re.sub(r"\s+", " ", p.text[h.start : h.end])) for h in shown} >= {("code-placeholders", "path/to/your"), ("code-placeholders", "YOUR_API_KEY"), ("code-typography", "→"), ("code-typography", "«")}
    assert all(a.end <= b.start for a, b in zip(shown, shown[1:], strict=False))
    e = {r.id: r for r in evidence.collect()}
    assert e["code-placeholders"]["count"] == 2 and e["code-placeholders"].in_files == 2 and e["code-placeholders"].evidence[0].startswith("app/src/a.ts : ") and len(e["code-typography"].evidence) == 3
    assert e["code-steps"].evidence[1].startswith("app/src/b.py : ")


@pytest.mark.parametrize("seed", [1, 2])
def test_the_budget_is_greedy(spark, seed):
    r = random.Random(seed)
    rows = [(p, i, f"{r.choice('abB')}{i:03}.py", r.choice([5, 50, 300, 2000]), r.random() < 0.1) for p in "xyz" for i in range(60)]
    df = spark.createDataFrame(rows, "project string, ord int, path string, chars int, blank boolean")
    got = {(g.project, g.ord): (g.state, g.start, g.end) for g in projects.placed(df, 1500, 1000).collect()}
    for p in "xyz":
        total = 0
        # letters go before their capitals, as people sort them
        for _, i, path, chars, blank in sorted((x for x in rows if x[0] == p), key=lambda x: (x[2].lower(), x[2].swapcase())):
            want = ("left", None, None)
            if total < 1500 and chars > 1000:
                want = ("large", None, None)
            elif total < 1500 and not blank and total + chars <= 1500:
                start = total + len(f"===== {path} =====\n")
                want, total = ("read", start, start + chars), start + chars + 2
            assert got[p, i] == want


def test_places_of_a_file(spark):
    js = "// Get the user\nconst a = getUser();\n// Update cart items\nupdateCartItems(a);\n\n// Delete old session\ndeleteOldSession();\n// Why this is here\nfoo(bar);\n// Save user settings\nsaveUserSettings(a);\n"
    banner = "// SERVICE — the heart of it\nx();\n"
    df = spark.createDataFrame([(1, js, "js"), (2, banner, "ts"), (3, "", "py")], "i int, t string, e string")
    got = {r.i: r for r in df.select("i", "t", places.code_places(F.col("t"), F.col("e")).alias("p")).collect()}
    para = next(p for p in got[1].p if p.id == "code-paraphrase")
    assert para["count"] == 4 and [got[1].t[h.start : h.end] for h in para.at] == ["// Get the user", "// Update cart items", "// Delete old session", "// Save user settings"]
    assert para.evidence[0] == "// Get the user const a = getUser();…" and len(para.evidence) == 2
    assert [(p.id, p.evidence) for p in got[2].p] == [("code-banner", ["// SERVICE — the heart of it"])] and got[3].p == []
