"""Reading pages as trees: end tags that may be missing, elements that are never ended, names without values; shared blocks."""

import random

import pytest

from provenir.llm import htmltext

OPTIONAL = frozenset("p li td th tr dt dd tbody thead head body html option".split())


def blocks(page):
    return [t for t, _ in htmltext.blocks_of(page)[0]]


def grown(r, depth=0):
    """A random tree of (name, attributes, children) and texts that HTML allows."""
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    phrase = lambda: [word() + " ", ("b", "", [word()]), " " + word()] if r.random() < 0.4 else [word()]
    if depth > 3:
        return ("p", "", phrase())
    kind = r.choice(["p", "p", "div", "ul", "table", "dl", "section", "nav", "blockquote", "h2", "comments"])
    inner = lambda: [grown(r, depth + 1) for _ in range(r.randint(1, 3))]
    if kind in ("p", "h2"):
        return (kind, "", phrase())
    if kind == "ul":
        return ("ul", "", [("li", "", [*phrase(), *(inner() if r.random() < 0.4 else [])]) for _ in range(r.randint(1, 3))])
    if kind == "dl":
        return ("dl", "", [x for _ in range(2) for x in (("dt", "", phrase()), ("dd", "", inner()))])
    if kind == "table":
        return ("table", "", [("tbody", "", [("tr", "", [("td", "", inner() if r.random() < 0.5 else phrase()) for _ in range(2)]) for _ in range(2)])])
    if kind == "comments":
        return ("div", ' class="comments"', inner())
    return (kind, "", inner())


def written(node, r):
    """The tree as HTML; end tags that may be left out are, at random where r is given."""
    if isinstance(node, str):
        return node
    name, attributes, children = node
    out = f"<{name}{attributes}>"
    for i, c in enumerate(children):
        after = children[i + 1] if i + 1 < len(children) else None
        text = written(c, r)
        if r and not isinstance(c, str) and c[0] in OPTIONAL and r.random() < 0.6:
            if c[0] == "p" and (after is None and name != "a" or after is not None and not isinstance(after, str) and after[0] in htmltext.ENDS_P) or c[0] != "p" and (after is None or not isinstance(after, str)):
                text = text[: -len(f"</{c[0]}>")]
        out += text
    return out + f"</{name}>"


def expected(node, out, line, skip=False):
    if isinstance(node, str):
        if not skip:
            line.append(node)
        return
    name, attributes, children = node
    inside = skip or name == "nav" or "comments" in attributes

    def end():
        if line and (t := " ".join("".join(line).split())):
            out.append(t)
        line.clear()

    if name in htmltext.BLOCK:
        end()
    for c in children:
        expected(c, out, line, inside)
    if name in htmltext.BLOCK:
        end()


@pytest.mark.parametrize("seed", range(300))
def test_end_tags_that_may_be_missing(seed):
    r = random.Random(seed)
    article = ("article", "", [grown(r) for _ in range(4)])
    page = ("html", "", [("head", "", [("title", "", ["T"])]), ("body", "", [grown(r), ("div", "", [grown(r), article]), grown(r)])])
    want = []
    expected(article, want, [])
    assert blocks(written(page, None)) == want
    assert blocks(written(page, r)) == want


def test_what_is_never_ended_swallows_nothing():
    article = "<article><p>Hello</p></article>"
    for page in (
        f"<html><head><title>T</title><body>{article}</body></html>", f"<html><head><title>T</title>{article}", f"<div><form>x</div>{article}", f"<div><nav>menu</div>{article}",
        f"<nav>menu{article}", f"<ul><li><form>x<li>{article}</ul>", f"<table><tr><td><nav>x<td>{article}</table>", f"<p hidden>x{article}", f"<div hidden>x</div>{article}",
        f"<aside><article>Teaser</article></aside>{article}", f"<div><nav><ul><li>a</div>{article}", f"<span hidden><span>x</span>y</span>{article}", f"<head><p>x</head>{article}",
    ):
        assert blocks(page) == ["Hello"], page
    assert blocks("<head><title>T</title>Hello<p>you") == ["Hello", "you"]


def test_nothing_else_is_dropped():
    assert blocks("<article><p>Let <math><mi>x</mi></math> be <svg><title>t</title><style>s</style><text>drawn</text></svg>.</p><xmp><b>&amp;</xmp></article>") == ["Let x be drawn.", "<b>&amp;"]
    assert blocks('<article><p>a<div hidden>x</div><div hidden="until-found">b</div><p HIDDEN=hidden>y<p title="hidden">c</article>') == ["a", "b", "c"]
    assert blocks("<main><ul><li>a<ul><li>b</ul><li>c</ul><dl><dt>d<dd>e<dt>f</dl></main>") == ["a", "b", "c", "d", "e", "f"]
    assert blocks("<article>" + "<div><p>x" * 2000 + "</article><p>after") == ["x"] * 2000


def test_shared_notices_go_and_copies_stay(spark):
    r = random.Random(8)
    words = lambda n: " ".join("".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(n))
    notice, foot, menu = words(60), words(25), "Home - About"
    own = [words(20) for _ in range(3)]
    rows = [(i, "http://h.org/a", f"<div>{notice}</div><div>{menu}</div><p>{own[i]}</p><div>{foot}</div>") for i in range(3)]
    text = [words(40), words(40)]
    rows += [(10, "http://c.org/a", f"<p>{text[0]}</p><p>{text[1]}</p>"), (11, "http://c.org/b", f"<p>{text[0]}</p><p>{text[1]} more</p>"), (12, "http://c.org/b", f"<p>{text[0]}</p><p>{text[1]} more</p>")]
    rows += [(20, None, f"<p>{notice}</p>"), (21, None, f"<p>{words(30)}</p>"), (22, "http://h2.org", None)]
    got = {x.page_id: x.text for x in htmltext.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[i] for i in range(3)] == own
    assert got[10].split("\n\n") == text and got[11] == got[12] == f"{text[0]}\n\n{text[1]} more"
    assert got[20] == notice and got[22] == ""


def test_every_page_goes_through_the_search(spark, monkeypatch):
    r = random.Random(9)
    words = lambda n: " ".join("".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(n))
    bar, part, own = words(20), words(30), [words(40) for _ in range(12)]
    # the same bar is all that is in doubt on these pages
    rows = [(i, "http://h.org/a", f'<article><p>{own[i]}</p><div class="share">{bar}</div></article>') for i in range(2)]
    # what is in doubt here is an article's there, split otherwise
    rows += [(10, "http://g.org/a", f"<article><p>{own[2]}</p><p>{part}</p></article>"), (11, "http://g.org/b", f"<p>{own[3]}</p><p>{part[:100]}</p>")]
    # as many pages have it in an article as have it in doubt
    rows += [(20 + i, "http://f.org/a", f"<article><p>{own[4 + i]}</p><p>{part}</p></article>") for i in range(2)]
    rows += [(22 + i, "http://f.org/b", f"<p>{own[6 + i]}</p><p>{part}</p>") for i in range(2)]
    rows += [(30 + i, "http://e.org/b", f"<p>{own[8 + i]}</p><p>{part}</p>") for i in range(2)]
    seen = []
    monkeypatch.setattr(htmltext, "repeated", lambda docs, *a, f=htmltext.repeated, **b: seen.append({x.stream for x in docs.collect()}) or f(docs, *a, **b))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = htmltext.main_text(pages, shared="n").collect()
    got = {x.page_id: x.text for x in found}
    assert seen[0] == {"\n".join(blocks(html)) for _, _, html in rows} and not any(x.n for x in found)
    assert [got[i] for i in range(2)] == own[:2]
    assert got[10] == f"{own[2]}\n\n{part}" and got[11] == f"{own[3]}\n\n{part[:100].strip()}"
    assert [got[20 + i] for i in range(4)] == [f"{own[4 + i]}\n\n{part}" for i in range(4)]
    assert [got[30 + i] for i in range(2)] == own[8:10]


def test_bytes_that_articles_share(spark):
    r = random.Random(10)
    words = lambda n: " ".join("".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(n))
    part, own = words(80), [words(100) for _ in range(4)]
    page = lambda *t: "<nav>menu</nav><article>" + "".join(f"<p>{x}</p>" for x in t) + "</article>"
    rows = [(1, "http://h.org/a", page(own[0], part)), (2, "http://h.org/b", page(part, own[1])), (3, "http://g.org/a", page(own[2], part)), (4, "http://h.org/c", page(own[3], part[:398])), (5, "http://h.org/d", None), (6, "http://k.org/a", page(part)), (7, "http://k.org/a", page(part))]
    got = {x.page_id: x for x in htmltext.main_text(spark.createDataFrame(rows, "page_id long, url string, html string"), shared="n_shared").collect()}
    assert [got[i].n_shared for i in range(1, 8)] == [len(part), len(part), 0, 0, 0, 0, 0]  # repeated rows are one page
    assert got[1].text == f"{own[0]}\n\n{part}" and got[2].text == f"{part}\n\n{own[1]}" and got[4].text == f"{own[3]}\n\n{part[:398].strip()}" and got[5].text == ""
