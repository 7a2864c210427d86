"""Families, pages, links and texts that an early end, a wide word test or a dropped reference got wrong."""

import random

from pyspark.sql import functions as F

from provenir.llm import htmltext, ngramjoin, urlfilter


def test_ngram_pivot_rounds_without_pairs(spark):
    r = random.Random(5)
    made = lambda n: ["".join(r.choice("abcdefghij") for _ in range(7)) for _ in range(n)]
    passage, rows = made(40), []
    for i in range(5):
        a = made(103)
        rows += [(i, " ".join(a + passage)), (100 + i, " ".join(a)), (200 + i, " ".join([*a[:-1], "other"]))]
    rows += [(1000 + i, " ".join(made(900))) for i in range(30)]
    sets = {i: {tuple(w[k : k + 4]) for k in range(len(w) - 3)} for i, w in ((i, t.split()) for i, t in rows)}
    links = {(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])}
    assert links == {(100 + i, 200 + i) for i in range(5)}
    got = ngramjoin.link_components(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85).where("component_id <> doc_id").collect()
    assert {(x.component_id, x.doc_id) for x in got} == links


def test_html_names():
    text = lambda page: [t for t, _ in htmltext.blocks_of(page)[0]]
    assert text('<article class="post no-sidebar"><h2 id="related-work">A</h2><p id="share">B</p><h2 id="social">C</h2></article>') == ["A", "B", "C"]
    assert text('<div class="content-sidebar-wrap"><p>A</p></div>') == ["A"] == text('<div class="widget"><ul class="menu"><li>x</ul><article><p>A</p></article></div>')
    assert text('<article class="banner"><p>A<div class="ad">buy</div><div id="x" class="y comments">C</div></article><div class="sidebar"><article>Z</article></div>') == ["A"]
    assert text('<main><div class="social"><article><p>A</p></article></div></main>') == ["A"]


def test_url_references(spark):
    page = lambda tag, base="": f"<head>{base}{tag}</head>"
    canon = '<link rel="canonical" href="{}">'.format
    cases = [
        (canon("page2.html"), "", "http://h.org/d/page2.html"), (canon("../x"), "", "http://h.org/x"), (canon("../../../x/./y/.."), "", "http://h.org/x/"), (canon("?id=1"), "", "http://h.org/d/p?id=1"),
        (canon("/login?next=http://x"), "", "http://h.org/login?next=http://x"), (canon("e?u=http://x/../y"), "", "http://h.org/d/e?u=http://x/../y"), (canon("//o.net/a"), "", "http://o.net/a"), (canon("HTTPS://o.net/a"), "", "HTTPS://o.net/a"),
        (canon("mailto:a@b.c"), "", None), (canon("#top"), "", None), (canon("q"), '<base href="/z/w">', "http://h.org/z/q"), (canon("q"), '<base target="_top" href="http://b.org">', "http://b.org/q"),
        ('<meta http-equiv="refresh" content="0; /x">', "", "http://h.org/x"), ('<meta http-equiv="refresh" content="5;URL=\'y?url=1\'">', "", "http://h.org/d/y?url=1"), ('<meta http-equiv="refresh" content="0;url=">', "", None), ('<meta http-equiv="refresh" content="30">', "", None),
    ]
    for tag, base, want in cases:
        got = [x.b for x in urlfilter.edges_of(spark.createDataFrame([("http://h.org/d/p?q=1#f", page(tag, base))], "url string, html string")).collect()]
        assert got == ([want] if want else []), tag
    rules = spark.createDataFrame([("bad.com", "/", "block")], "host string, path string, verdict string")
    rows = [(1, "http://bad.com/d/p", canon("q")), (2, "http://bad.com/d/q", ""), (3, "http://o.org/a", '<meta http-equiv="refresh" content="0; http://bad.com/d/q">')]
    out = urlfilter.filter_urls(spark.createDataFrame(rows, "page_id long, url string, html string"), rules).collect()
    assert {x.page_id: x.verdict for x in out} == {1: "block", 2: "block", 3: "block"} and len({x.component for x in out}) == 1
