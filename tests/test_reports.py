"""Trackers, evidence, software, code, projects, reports and recalibration on small cases."""

import re

from pyspark.sql import functions as F

from provenir.functions import clean, show, text
from provenir.operators import calibrate, corpus, explain, files, recalibrate, software, verdict
from provenir.operators.detect import SIGNAL, signal
from provenir.plans.analyze import analyzed, domain_of, summaries


def one(spark, make, *values, kinds="string"):
    df = spark.createDataFrame([values], ", ".join(f"c{i} {k}" for i, k in enumerate([kinds] * len(values) if isinstance(kinds, str) else kinds)))
    return df.select(make(*[F.col(c) for c in df.columns]).alias("x")).first().x


def test_trackers_are_taken_out_in_one_pass(spark):
    cases = {
        "https://a/575?utm_source=chatgpt.com&utm_source=openai&z=1": "https://a/575?utm_source=openai&z=1",
        "https://a/?utm_source=openai": "https://a/", "https://a/?x=1&utm_source=Claude.ai&y=2": "https://a/?x=1&y=2", "https://a/?x=1&utm_source=gemini": "https://a/?x=1",
        "https://a/?utm_source=perplexity.ai&utm_source=grok&utm_source=bard": "https://a/?utm_source=grok", "https://a/?utm_source=feed": "https://a/?utm_source=feed", "https://a/?": "https://a/",
    }
    got = {r.u: r.v for r in spark.createDataFrame([(u,) for u in cases], "u string").select("u", clean.without_tracker(F.col("u")).alias("v")).collect()}
    assert got == cases


def test_diversity_matches_windows(spark):
    import random

    r = random.Random(4)
    rows = [(i, " ".join(r.choice("ab cd ef gh ij kl Mn mn".split()) for _ in range(n))) for i, n in enumerate((0, 1, 49, 50, 51, 130))] + [(9, None)]

    def brute(t):
        w = [x.lower() for x in re.findall(r"[^\W\d_]+", t or "")]
        if not w:
            return 0.0
        v = len(set(w)) / len(w) if len(w) <= 50 else sum(len(set(w[i : i + 50])) for i in range(len(w) - 49)) / 50 / (len(w) - 49)
        return int(v * 100 + 0.5) / 100

    got = {x.k: x.lexical_diversity for x in text.lexical_diversity(spark.createDataFrame(rows, "k long, text string"), "k").collect()}
    assert got == {k: brute(t) for k, t in rows}


def test_what_cannot_be_seen(spark):
    assert one(spark, explain.visible, "a\u200bb\u202fc\ue200d\U000e0041\U000e0042  e\n") == "a⟦ZWSP⟧b⟦NNBSP⟧c⟦U+E200⟧d⟦TAG⟧ e "
    t = "x" * 50 + "MARK" + "y" * 10
    assert one(spark, lambda c: explain.excerpt(c, F.lit(50), F.lit(54)), t) == "…" + "x" * 40 + "MARK" + "y" * 10
    assert one(spark, explain.hidden_messages, "a" + "".join(chr(0xE0000 + ord(c)) for c in "hi you") + "b") == ["hi you"]


def test_highlights_are_disjoint_and_ordered(spark):
    t = "**bold** word " * 3 + "contentReference[oaicite:1]{index=1} and **x contentReference[oaicite:2]{index=2} y** end. " + "plain words here. " * 20
    x = analyzed(spark.createDataFrame([(1, t)], "doc_id long, text string"))
    e = explain.explained(x, "doc_id")
    h = explain.highlighted(e, "doc_id").first().highlights
    assert all(a.end <= b.start for a, b in zip(h, h[1:])) and [t[a.start : a.end] for a in h if a.id == "art-oaicite"] == ["contentReference[oaicite:1]{index=1}", "contentReference[oaicite:2]{index=2}"]
    assert not any(a.id == "art-markdown" and "oaicite" in t[a.start : a.end] for a in h)
    ev = {r.id: r.evidence for r in e.collect()}
    assert len(ev["art-oaicite"]) == 2 and ev["art-oaicite"][0].startswith("…bold** word **bold** word")


def test_software(spark):
    raw = {"pdf.creator": "Microsoft Word 2019", "pdf.producer": "Microsoft: Print To PDF; microsoft word", "docx.creator": "Jane"}
    got = spark.createDataFrame([(raw,)], "r map<string,string>").select(software.software_of(F.col("r")).alias("s")).first().s
    assert [(s.name, s.confidence) for s in got] == [("Microsoft Word", 95)] and got[0].source == "Créateur du PDF : « Microsoft Word 2019 » · Producteur du PDF : « Microsoft: Print To PDF; microsoft word »"
    got = spark.createDataFrame([({"docx.hasapp": "0"},)], "r map<string,string>").select(software.software_of(F.col("r")).alias("s")).first().s
    assert [(s.name, s.confidence) for s in got] == [("Programme non identifié", 60)]


def brute_paraphrases(t, ext):
    """The rule by hand, line by line, for languages with // comments and Python."""
    lines = t.split("\n")

    def comment(line):
        m = re.match(r"^\s*#(?!!)\s*(.*?)\s*$", line) if ext in files.HASH_ONLY else re.match(r"^\s*//\s*(.*?)\s*$", line)
        m = m or re.match(r"^\s*\{?/\*+\s*(.*?)\s*\*/\}?\s*$", line)
        return m[1] if m else None

    def says(word, parts):
        w = word[:-1] if len(word) > 3 and word.endswith("s") else word
        for p in parts:
            if p in (w, word) or len(w) >= 4 and len(p) >= 4 and (p.startswith(w) or w.startswith(p)):
                return True
        means = next((v.split() for k, v in files.FRENCH.items() if word.startswith(k)), [])
        return any(e in parts for e in means)

    said, eligible, found = [comment(x) for x in lines], 0, []
    for i, c in enumerate(said):
        if c is None or i and said[i - 1] is not None or re.match(files.TOOLING, c, re.I) or re.search(r"[;{}=()<>]", c):
            continue
        j = i + 1
        while j < len(lines) and not lines[j].strip():
            j += 1
        if j >= len(lines) or said[j] is not None or j - i > 2:
            continue
        ws = [w for w in re.findall("[a-zà-ÿ]+", c.lower()) if len(w) >= 3 and w not in files.SILENT]
        if not 2 <= len(ws) <= 8:
            continue
        eligible += 1
        parts = {p.lower() for name in re.findall(r"[A-Za-z_$][A-Za-z0-9_$]*", lines[j]) for p in re.split(r"(?<=[a-z0-9])(?=[A-Z])|[_$]+", name) if len(p) >= 2}
        if sum(says(w, parts) for w in ws) / len(ws) >= 0.66:
            found.append((i + 1, j + 1))
    return found if len(found) >= 3 and eligible >= 4 and len(found) / eligible >= 0.3 else None


def test_comments_that_repeat_the_code(spark):
    js = "// Get the user\nconst a = getUser();\n// Update cart items\nupdateCartItems(a);\n\n// Delete old session\n\ndeleteOldSession();\n// Why this is here\nfoo(bar);\n// one\n// two lines\nx();\n/* Save user settings */\nsaveUserSettings();\n// far away code\n\n\ny();\n// todo get user\ngetUser();\n"
    py = "# Récupère les données utilisateur\nuser_data = get_user_data()\n# Vérifie le fichier\ncheck_file(x)\n# Affiche la réponse\nshow_response(r)\n# something else entirely\npass\n#!no\n"
    cases = [(js, "js"), (py, "py"), ("// a b c\nx\n", "js"), ("", "py"), (js, "py")]
    got = [tuple(map(tuple, r.p)) if r.p is not None else None for r in spark.createDataFrame(cases, "t string, e string").select(files.paraphrases(F.col("t"), F.col("e")).alias("p")).collect()]
    assert got == [tuple(w) if (w := brute_paraphrases(t, e)) else None for t, e in cases] and got[0] and got[1]


def test_projects(spark):
    x = spark.createDataFrame([(1, "a.py", "py", "# Step 1: a\n# Step 2: b\n"), (1, "b.py", "py", "# Step 1: a\n# Step 2: b\n# Step 3: c\n"), (1, "c.py", "py", "x"), (2, "d", None, None)], "p int, path string, extension string, text string")
    got = {r.p: r for r in files.project_code(x, "p").collect()}
    assert got[1].files == 3 and [(s.id, s["count"]) for s in got[1].signals] == [("code-steps", 5)] and got[1].in_files == [2] and got[2].signals == []
    assert one(spark, files.shallowest_head, ["a/b/.git/HEAD", "z/.git/HEAD", "c/.git/HEAD", "HEAD"], kinds=["array<string>"]) == "z/.git/HEAD"
    assert one(spark, files.shallowest_head, ["averylongname/.git/HEAD", "a/b/.git/HEAD"], kinds=["array<string>"]) == "a/b/.git/HEAD"
    c = spark.createDataFrame([(1, k, "d", "d@x", "Work\n\nCo-authored-by: Claude <x>") for k in range(3)] + [(1, 9, "d", "d@x", "Plain")], "p int, ord int, author string, email string, message string")
    r = files.commits_by_tool(c, "p").first()
    assert (r.tool, r.vendor, r.commits, r.total, r.first) == ("Claude Code", "claude", 3, 4, ["Claude Code : « Work »"] * 2)


def test_files_reach_the_verdict(spark):
    x = spark.createDataFrame([(1, "docx", {"docx.creator": "python-docx"}, "", "word " * 30), (2, "code", {}, "py", "# Here is the updated code\nx\n"), (3, "text", None, None, "word " * 30)], "doc_id long, kind string, raw map<string,string>, extension string, text string")
    got = {r.doc_id: [s.id for s in r.signals] for r in analyzed(x, kind=F.col("kind"), more=(files.file_signals(),)).collect()}
    assert "meta-docx-lib" in got[1] and "code-chat" in got[2] and not any(s.startswith(("meta", "code")) for s in got[3])


def test_model_domain_and_status(spark):
    rows = [(1, "text", "plain words " * 40), (2, "code", "x"), (3, "text", "one two"), (4, "pdf", "1 2 3\n" * 40 + "A line with enough plain words to count as prose here.\n" * 10)]
    d = spark.createDataFrame(rows, "doc_id long, kind string, text string")
    m = spark.createDataFrame([(1, 100, -2.0, 2.1, 1.5, None), (2, 100, -2.0, 2.1, 1.5, None), (4, 100, -2.0, 2.1, 1.5, 0.9)], "doc_id long, tokens int, mean_log_prob double, mean_entropy double, criterion double, binoculars double")
    got = {r.doc_id: (r.model_status, r.model_domain, [s.id for s in r.signals if s.category == "model"]) for r in analyzed(d, kind=F.col("kind"), measures=m).collect()}
    assert got[1] == ("used", "prose", ["model-likelihood"]) and got[2] == ("skipped", None, []) and got[3] == ("skipped", None, []) and got[4][:2] == ("used", "technical")
    assert analyzed(d.where("doc_id = 1"), kind=F.col("kind"), measures=m.limit(0)).first().model_status == "unavailable"
    assert one(spark, lambda t: domain_of(t, F.lit("text")), "\n".join(["Sous le ciel bleu du matin", "Je marche vers le lointain"] * 4)) == "verse"


def test_shown_values(spark):
    assert [one(spark, show.pdf_date, d) for d in ("D:20240305", "D:20240305112233+02'00'", "D:20240305112233Z", "soon")] == ["05/03/2024 00:00:00 (fuseau non précisé)", "05/03/2024 11:22:33 (UTC+02:00)", "05/03/2024 11:22:33 (UTC)", "soon"]
    assert [one(spark, show.size, n, kinds="long") for n in (1023, 1536, 3 << 20)] == ["1023 o", "1.5 Ko", "3.0 Mo"]
    m = one(spark, show.model_uri, "hf:org/Some-1.5B-Instruct-GGUF:Q4_K_M")
    assert (m.name, m.parameters, m.quantization) == ("Some-1.5B-Instruct", "1,5", "Q4_K_M")
    x = spark.createDataFrame([([("key", "Microsoft Word"), ("k", "ab")], ["Outil : « Microsoft Word »", "ab"])], "m array<struct<key:string,value:string>>, e array<string>")
    assert [f.flagged for f in x.select(explain.flagged(F.col("m"), F.col("e")).alias("f")).first().f] == [True, False]


def test_summaries_name_the_best_traced_assistant(spark):
    d = spark.createDataFrame([(1, "a [cite_start] b [cite: 1] " + "word " * 40), (2, "nothing here")], "doc_id long, text string")
    got = {r.doc_id: r for r in summaries(analyzed(d)).collect()}
    assert got[1].top_vendor == "gemini" and got[2].top_vendor is None and got[2].excerpt == "nothing here"
    v = verdict.vendors_of(analyzed(d), "doc_id").where("doc_id = 1 and level <> 'aucun'").collect()
    assert [r.vendor for r in v] == ["gemini"]


def test_corpus_tools(spark):
    m = spark.createDataFrame([("humain", "wiki", "humain-wiki-009"), ("humain", "wiki", "humain-wiki-1200")], "label string, genre string, id string")
    new = spark.createDataFrame([("humain", "wiki", 1), ("humain", "news", 2), ("humain", "news", 3)], "label string, genre string, ord int")
    assert sorted(r.id for r in corpus.numbered(new, m).collect()) == ["humain-news-001", "humain-news-002", "humain-wiki-1201"]
    p = [one(spark, corpus.article_text, ["short", "w " * 200, "v " * 120, "u " * 50], kinds=["array<string>"])]
    assert len(p[0].split()) == 320 and "short" not in p[0]
    t = corpus.prompts(spark.range(5).withColumnRenamed("id", "ord"), (10, 20), ("x", "y")).orderBy("ord").collect()
    assert [(r.prompt_id, r.words, r.style, r.batch) for r in t] == [("p01", 10, "x", 1), ("p02", 20, "x", 1), ("p03", 10, "y", 1), ("p04", 20, "y", 1), ("p05", 10, "x", 1)]
    s = spark.createDataFrame([(False, 30, float(k)) for k in range(40)], "ai boolean, tokens int, score double")
    assert corpus.plain_thresholds(s).first().offset == 38.0


def test_recalibration(spark):
    import random

    r = random.Random(1)
    rows = [(k, k, bool(k % 2), 1, 40 + k % 160, -2.0 - (0.5 if k % 2 else 0) + r.random(), 2.0 + r.random(), r.random() + (1 if k % 2 else 0), 0.9 + r.random() / 5 - (0.1 if k % 2 else 0) if k % 3 else None) for k in range(120)]
    base = spark.createDataFrame(rows, "sample_id long, sample_group long, ai boolean, weight long, tokens long, mean_log_prob double, mean_entropy double, criterion double, binoculars double")
    a = base.where("sample_id < 30").select(F.col("sample_id").alias("answer_id"), F.when(F.col("ai"), "ai").otherwise("human").alias("label"), F.lit(None).cast("string").alias("vendor"), F.lit("prose").alias("domain"), F.lit("m").alias("model"), F.current_timestamp().alias("at"), "tokens", "mean_log_prob", "mean_entropy", "criterion", "binoculars")
    out = recalibrate.proposed(base, a, "m").collect()
    assert {x.answers for x in out} == {30} and all(0 <= x.correct <= 30 and x.correct >= 20 for x in out) and recalibrate.proposed(base, a.limit(calibrate.MIN_ANSWERS - 1), "m") is None
    assert recalibrate.proposed(base, a, "other") is None
    assert {(x.kind, x.name): x.n for x in recalibrate.answers_summary(a, "m").collect()} == {("label", "ai"): 15, ("label", "human"): 15, ("vendor", "autre"): 15, ("label", "unused"): 0}


def test_calibrations_saved_and_reset(spark, tmp_path):
    schema = "formula string, bias double, weight array<double>"
    path = f"{tmp_path}/calibration"
    c = spark.createDataFrame([("three", 0.5, [1.0, 2.0])], schema)
    recalibrate.saved(spark, c, path, F.timestamp_seconds(F.lit(10)))
    recalibrate.saved(spark, c.withColumn("bias", F.lit(0.7)), path, F.timestamp_seconds(F.lit(20)))
    assert [r.bias for r in recalibrate.in_force(spark, path, schema).collect()] == [0.7]
    recalibrate.saved(spark, c.withColumn("weight", F.lit(None).cast("array<double>")), path, F.timestamp_seconds(F.lit(30)))
    assert recalibrate.in_force(spark, path, schema).count() == 0


def test_project_files_are_read_by_file(spark):
    import io
    import zipfile

    from provenir.sources import readers

    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        z.writestr("a/x.py", "# Step 1: a\n# Step 2: b\n")
        z.writestr("node_modules/y.js", "x")
        z.writestr("a/CLAUDE.md", "notes")
    f = spark.createDataFrame([("p.zip", held.getvalue()), ("p", held.getvalue()), ("t.txt", b"text")], "path string, content binary")
    rows = readers.read_projects(f)
    assert sorted((r.project, r.path) for r in rows.collect()) == [("p", "a/CLAUDE.md"), ("p", "a/x.py"), ("p.zip", "a/CLAUDE.md"), ("p.zip", "a/x.py")]
    got = {r.project: [s.id for s in r.signals] for r in files.project_code(rows, "project").collect()}
    assert got == {"p": ["code-steps"], "p.zip": ["code-steps"]}
    assert {r.path: r.kind for r in readers.read_files(f).collect()} == {"p.zip": "code", "p": "code", "t.txt": "txt"}


def test_summaries_and_assistants(spark):
    sig = lambda *s: F.array(*s)
    art = signal(1, "art-x", "artefact", "fort", "ia", 40, None, (("claude", 3),))
    weak = signal(2, "sty-x", "style", "faible", "ia", 5)
    man = signal(3, "sty-casual", "style", "faible", "humain", -8)
    lib = signal(4, "meta-docx-lib", "metadata", "moyen", "ia", 25, None, (("script", 1), ("claude", 1)))
    df = spark.range(1)
    cases = [
        (sig(art, weak, man), 200, "1 trace(s) technique(s), 1 indice(s) de style, 1 marque(s) humaine(s). Au moins une trace quasi certaine a été trouvée."),
        (sig(weak, man), 200, "aucune trace technique, 1 indice(s) de style, 1 marque(s) humaine(s). Sans trace technique, le résultat repose sur le style : c'est une tendance, pas une preuve."),
        (sig(lib), 200, "1 trace(s) technique(s), 0 indice(s) de style."),
    ]
    for signals, words, want in cases:
        x = verdict.scored(df.select(signals.alias("signals"), F.lit(words).cast("long").alias("words"))).select("summary", verdict.assistants(F.col("signals")).alias("a")).first()
        assert x.summary == want
    short = verdict.scored(df.select(F.array().cast(f"array<{SIGNAL}>").alias("signals"), F.lit(12).cast("long").alias("words"))).first()
    assert short.undetermined and short.summary.startswith("Texte court (12 mots)") and short.confidence == "faible"
    assert [(v.vendor, v.score, v.level, v.reasons) for v in x.a][:2] == [("claude", 16, "indice", ["meta-docx-lib"]), ("script", 16, "indice", ["meta-docx-lib"])]
    both = verdict.vendors_of(df.select("id", sig(art, lib).alias("signals")), "id").where("score > 0").orderBy("ord").collect()
    assert [(v.vendor, v.score, v.level) for v in both] == [("claude", 88, "trace"), ("script", 16, "indice")]
