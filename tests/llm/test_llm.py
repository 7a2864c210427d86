"""Small cases of every operator: ties, nulls, empty texts, repeated rows, extra columns, and brute force where it fits."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from provenir.llm import bpe, decontaminate, embeddup, htmltext, langid, ngramjoin, substrings, toxicity, urlfilter, warc
from provenir.llm.common import components
from provenir.llm.queries import vocabulary_path

DOCS = "doc_id long, text string, word string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x") for i, t in rows], DOCS)


def words(n, seed, size=400):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 6))) for _ in range(n))


def test_components(spark):
    rows = [(1, 2), (2, 3), (9, 3), (5, 6), (7, 7), (None, 1)] + [(100, k) for k in range(101, 160)]
    got = {r.node: r.component for r in components(spark.createDataFrame(rows, "a long, b long"), "a", "b").collect()}
    assert got == {1: 1, 2: 1, 3: 1, 9: 1, 5: 5, 6: 5} | {k: 100 for k in range(100, 160)}
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_decontaminate(spark):
    item = "one two three four five six seven eight nine ten eleven twelve"
    d = docs(spark, [(1, "X " + item.upper().replace(" ", "--") + " y"), (2, None), (3, ""), (4, "short item here"), (5, "one two three four five six seven eight nine"), (4, "short item here"), (6, "Été " + item)])
    b = spark.createDataFrame([("a", item), ("b", "short, item"), ("c", None), (None, "zzz")], "item_id string, text string")
    got = sorted((r.doc_id, r.n_words, r.n_hit, r.n_items, r.contaminated) for r in decontaminate.report(d, b).collect())
    assert got == [(1, 14, 12, 1, True), (2, 0, 0, 0, False), (3, 0, 0, 0, False), (4, 3, 2, 1, True), (4, 3, 2, 1, True), (5, 9, 0, 0, False), (6, 13, 12, 1, True)]
    assert sorted(r.doc_id for r in decontaminate.decontaminate(d, b).collect()) == [2, 3, 5]
    cut = {r.doc_id: r.text for r in decontaminate.decontaminate(d, b, mode="spans").collect()}
    assert cut[1] == "X y" and cut[4] == "here" and cut[5].startswith("one") and cut[2] is None
    assert decontaminate.report(d.limit(0), b).count() == 0 and decontaminate.report(d, b.limit(0)).where("contaminated").count() == 0


def test_embeddings_brute(spark):
    r = np.random.default_rng(1)
    base = r.standard_normal((40, 16))
    x = np.concatenate([base, base[:20] + 0.05 * r.standard_normal((20, 16)), base[:3], r.standard_normal((200, 16))])
    rows = [(i, [float(v) for v in e]) for i, e in enumerate(x)] + [(900, None), (901, []), (902, [0.0] * 16), (903, [float("nan")] * 16), (904, [None] * 16), (905, [1.0]), (None, [1.0] * 16)]
    old, embeddup.BLOCK = embeddup.BLOCK, 8
    got = {q.vec_id: q for q in embeddup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), miss=1e-6).collect()}
    embeddup.BLOCK = old
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (u @ u.T >= 0.9) & ~np.eye(len(x), dtype=bool)
    assert [got[i].n_links for i in range(len(x))] == near.sum(1).tolist()
    least = np.arange(len(x))
    for _ in range(20):
        least = np.array([min([least[i], *least[near[i]]]) for i in range(len(x))])
    assert [got[i].component_id for i in range(len(x))] == least.tolist()
    assert all(got[i].n_links == 0 and got[i].kept for i in (900, 901, 902, 903, 904, 905)) and got[None].component_id is None


def test_bpe_matches_library(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(vocabulary_path())
    r = random.Random(3)
    texts = ["", "It's <|endoftext|>Hello<|startoftext|> 'S 12", "ΑΣ İ é ﬁ 漢字 😀​\x85 don't", *["".join(r.choice("etaoinéß'.,0 ") for _ in range(r.randint(0, 80))) for _ in range(300)]]
    got = {x.doc_id: x for x in bpe.round_trip(docs(spark, [*enumerate(texts), (1000, None)]), vocabulary_path()).collect()}
    for i, t in enumerate(texts):
        ids = tok.encode(t, add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids) and got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert got[1000].n_tokens == 0
    back = bpe.decode(bpe.encode(docs(spark, [(1, texts[1])]), vocabulary_path()), vocabulary_path(), into="again").first()
    assert back.again == tok.decode(tok.encode(texts[1], add_special_tokens=False).ids, skip_special_tokens=False) and back.word == "x"


def test_warc(spark):
    big = "é" * 600
    p = spark.createDataFrame([(1, "http://a/\r\nx", big), (2, None, big), (3, "u", "small"), (4, "u", "small"), (5, "u", None), (6, "u", "")], "page_id long, url string, html string")
    got = {r.page_id: r for r in warc.round_trip(p).collect()}
    assert (got[1].record_type, got[1].refers_to, got[2].record_type, got[2].refers_to) == ("revisit", 2, "response", None)
    assert all(got[i].record_type == "response" for i in (3, 4, 5, 6)) and got[5].payload_bytes == 0
    assert got[1].payload_digest == hashlib.sha1(big.encode()).hexdigest() and got[1].payload_bytes == 1200
    assert warc.round_trip(p.limit(0)).count() == 0


def test_url_filter(spark):
    rules = spark.createDataFrame([("com", "/", "allow"), ("bad.com", "/x/", "block"), ("net", "/", "block")], "host string, path string, verdict string")
    link = '<link href="{}" rel="canonical">'
    rows = [(1, "http://A.bad.com/x/1", ""), (2, "http://good.com/", ""), (3, "http://alias.org/p", link.format("http://n.net/q?a=1&amp;b=2")), (4, "http://both.org/", link.format("http://n.net/q?a=1&amp;b=2")), (5, None, None), (6, "nothing", ""), (7, "http://c.org/a", link.format("http://good.com/")), (8, "http://c.org/b", '<meta http-equiv="refresh" content="0; url=/a">'), (9, "http://m.net", "")]
    got = {r.page_id: (r.rule, r.verdict) for r in urlfilter.filter_urls(spark.createDataFrame(rows, "page_id long, url string, html string"), rules).collect()}
    assert got == {1: ("bad.com/x/", "block"), 2: ("com/", "allow"), 3: (None, "block"), 4: (None, "block"), 5: (None, "allow"), 6: (None, "allow"), 7: (None, "allow"), 8: (None, "allow"), 9: (None, "allow")}


def test_ngram_join_brute(spark):
    base = [words(120, k) for k in range(6)]
    rows = list(enumerate(base + base[:2] + [b.replace(" ", "\n") for b in base[:2]] + [" ".join(b.split()[:-5]) + " zz" for b in base] + [" ".join([*b.split()[:60], "new", *b.split()[60:]]) for b in base]))
    rows += [(500, None), (501, ""), (502, "one two"), (503, "ONE two"), (504, "one two three four five"), (505, "a " * 3000)]
    got = {r.doc_id: r for r in ngramjoin.link_components(docs(spark, [*rows, (503, "ONE two")]), 4, 85).collect()}
    table = {c: c + 32 for c in range(65, 91)}
    s = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(table))
        s[i] = {tuple(w[k : k + 4]) for k in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} - {()}
    least = {i: i for i in s}
    for _ in range(12):
        for i in s:
            for j in s:
                if i != j and s[i] and s[j] and 100 * len(s[i] & s[j]) >= 85 * len(s[i] | s[j]):
                    least[i] = min(least[i], least[j])
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == {i: (len(s[i]), least[i]) for i in s}
    assert ngramjoin.link_components(docs(spark, [(1, None)]), 4, 85).first().component_id == 1
    kept = ngramjoin.deduplicated(docs(spark, rows), 4, 85)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i in least if least[i] == i) and kept.columns == ["doc_id", "text", "word"]


def test_language_id(spark):
    de, en = "der die und das nicht ein ist mit sich auch ", "the and that with this from they have been will "
    r = random.Random(1)
    rows = [(i, " ".join(r.choices((de if i % 2 else en).split(), k=30)), "de" if i % 2 else "en") for i in range(200)]
    d = spark.createDataFrame([*rows, (900, None, "de"), (901, "123 !!", "en"), (902, "und das nicht mit", None)], "doc_id long, text string, lang string")
    got = {x.doc_id: x for x in langid.predict(d, langid.train(d)).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang in rows) and got[902].lang_pred == "de"
    assert got[900].lang_pred == got[901].lang_pred == "und" and got[900].lang_score == 0
    assert {x.lang_pred for x in langid.predict(d, langid.train(d.limit(0))).collect()} == {"und"}


def brute_cut(texts, w):
    seen = collections.Counter(t[i : i + w] for t in texts.values() for i in range(len(t) - w + 1))
    out = {}
    for k, t in texts.items():
        gone = bytearray(len(t))
        for i in range(len(t) - w + 1):
            if seen[t[i : i + w]] > 1:
                gone[i : i + w] = b"\1" * w
        out[k] = (bytes(b for b, g in zip(t, gone, strict=True) if not g), len(re.findall(b"\1+", bytes(gone))))
    return out


@pytest.mark.parametrize("hot", [4096, 2])
def test_substrings_brute(spark, hot):
    passage, other = words(150, 50), words(110, 51)
    rows = [(i, words(r % 120, 60 + i) + " " + passage[i % 7 : 700 - i] + " " + words(40, 90 + i)) for i, r in enumerate(range(3, 60, 7))]
    rows += [(100, other), (101, other), (102, "é" * 900), (103, None), (104, ""), (105, "short"), (106, words(70, 7) + other[:420] + "é" + other[30:]), (107, "ab" * 500)]
    old, substrings.HOT = substrings.HOT, hot
    got = {r.doc_id: r for r in substrings.report(docs(spark, rows)).collect()}
    substrings.HOT = old
    texts = {i: (t or "").encode() for i, t in rows}
    for i, (kept, runs) in brute_cut(texts, 400).items():
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == (len(texts[i]), len(texts[i]) - len(kept), runs, hashlib.sha256(kept).hexdigest()), i
    assert substrings.report(docs(spark, [(1, None)])).first().n_bytes == 0


def test_toxicity(spark):
    r = random.Random(2)
    rows, labels = [], []
    for i in range(400):
        w = r.choices("alpha beta gamma delta people women men went home today".split(), k=20)
        if i % 4 == 0:
            w[r.randrange(20)] = r.choice(["idiot", "idiots", "scum"])
        rows.append((i, " ".join(w)))
        labels.append((i, int(i % 4 == 0)))
    d = docs(spark, [*rows, (900, None), (901, "")])
    model = toxicity.train(d, spark.createDataFrame([*labels, (5000, 1), (1, None)], "doc_id long, toxic int"))
    got = {x.doc_id: x.toxicity for x in toxicity.predict(d, model).collect()}
    assert sum((got[i] >= 0.5) == bool(y) for i, y in labels) >= 396 and got[900] == got[901] < 0.5
    a, b = (toxicity.predict(docs(spark, [(1, f"the {w} went home")]), model).first().toxicity for w in ("women", "men"))
    assert abs(a - b) < 0.05
    none = toxicity.train(d, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.predict(d, none).agg(F.max("toxicity")).first()[0] < 1e-9


def test_html(spark):
    page = '<html><head><title>T</title></head><body><nav>menu</nav><div class="ad">buy</div><article><h1>Head &amp; more</h1><p>One<br>two <b>bold</b><p>Three<script>x</script><aside>side</aside></article><footer>f</footer>'
    rows = [(1, "http://h/1", page, 7), (2, "http://h/2", None, 7), (3, None, "", 7), (4, "http://h/4", "<p>plain &lt;text&gt;</p><p>cut off <a hre", 7)]
    shared = words(90, 5)
    rows += [(10 + k, "http://h/x", f"<p>{words(300, 70 + k)}</p><p>{shared}</p>", 7) for k in range(3)]
    got = {r.page_id: r for r in htmltext.main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text_hash int")).collect()}
    assert got[1].text == "Head & more\n\nOne two bold\n\nThree" and got[2].text == got[3].text == "" and got[1].text_hash == 7
    assert got[4].text == "plain <text>\n\ncut off" and all(shared not in got[10 + k].text and got[10 + k].text == words(300, 70 + k) for k in range(3))


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as p

    rows = [(i, words(60, i) + " und der die das", "de" if i % 2 else "en", "s", 1) for i in range(12)]
    rows += [(20, rows[0][1], "en", "s", 1), (21, None, "en", "s", 1), (22, "123", None, "s", 1), (23, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda", "en", "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = p.run(spark, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in got) == list(range(12)) and all(r.n_tokens > 0 for r in got)
