"""Main text of HTML pages: blocks by structure, and where structure leaves doubt, by strings that pages of a host share.

A page is read as a tree, with the end tags that HTML implies: one stack of open elements says of every text what it lies
in. What lies in elements that are never main text (scripts, styles, menus, headers and footers of the page, sidebars, forms,
adverts, reader comments, told by element, by role and, for containers, by class and id: whole names, never of the article
or what encloses it) is left out; if the page marks its article (article, main, role=main, itemprop=articleBody), only
blocks in there are read on. An element that is left out and never ended ends before an article. Blocks of a page that
marks no article are in doubt, as are those of an article in containers whose names may mean boilerplate (DOUBTFUL).

The blocks that are read on are the page's token stream. The streams of a host are searched together, with the anchored
suffix sorting of `substrings` (a host of any size is dealt out by content, never gathered), for strings that two or more
of them have:

- strings of LONG bytes or more over every page, marked or not: how many bytes of its stream a page shares is said in the
  column that `shared` names. They decide nothing by themselves, as an article may quote.
- strings of MIN_SHARED bytes or more over the pages with blocks in doubt. Streams that are near copies (five words, a
  similarity of 0.8) count as one. Blocks in doubt that such strings cover are boilerplate if the strings lie in blocks in
  doubt elsewhere too, which a search of these blocks alone says. So are blocks in doubt of any length that most of a
  host's three or more pages with blocks in doubt have. Blocks that are an article's on as many pages of the host, of all
  its pages, as they are in doubt on stay. A copy loses the blocks that the one it is a copy of loses.

Defined results: a null html is empty; text cut off inside a tag ends before the tag; a null url is a host of its
own name; repeated rows are one page (they don't make each other boilerplate); extra columns are kept, whatever they
are called.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType, StructField, StructType

from .bpe import light
from .common import written
from .ngramjoin import link_components
from .substrings import MAX_BROADCAST, hashes, repeated
from .urlfilter import host_of

MIN_SHARED = 64
#: Length of the strings that are counted over all pages.
LONG = 400
#: Similarity of near copies: words of a shingle, percent.
COPIES = (5, 80)
PIECE = re.compile(r"""<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|iframe|select|title|xmp)\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*)>|<[!?][^>]*>|<[/!?a-zA-Z][^<>]*\Z""", re.S | re.I)
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements within a line, which are not followed: what they hold is text of the block.
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What ends the head, which may have no end tag: every element but these.
IN_HEAD = frozenset("base basefont bgsound link meta noscript script style template title".split())
#: Start tags that end a paragraph that is open.
ENDS_P = BLOCK - frozenset("body caption head html legend tbody td tfoot th thead tr".split())
#: Elements that an end tag within them does not reach beyond, but for their own.
SCOPE = frozenset("td th caption table object html".split())
#: Start tags, the open elements that they end, and those that keep them from looking further out.
IMPLIED = {
    "li": (frozenset(["li"]), (BLOCK | SCOPE) - frozenset("address div p li".split())), **{n: (frozenset("dt dd".split()), (BLOCK | SCOPE) - frozenset("address div p dt dd".split())) for n in ("dt", "dd")},
    "td": (frozenset("td th".split()), frozenset("tr table".split())), "th": (frozenset("td th".split()), frozenset("tr table".split())), "tr": (frozenset(["tr"]), frozenset("tbody thead tfoot table".split())),
    "tbody": (frozenset("tbody thead tfoot caption".split()), frozenset(["table"])), "thead": (frozenset("tbody thead tfoot caption".split()), frozenset(["table"])), "tfoot": (frozenset("tbody thead tfoot caption".split()), frozenset(["table"])),
    "button": (frozenset(["button"]), frozenset()), "option": (frozenset(["option"]), frozenset()),
}
TABLE = frozenset("td th tr tbody thead tfoot caption table".split())
NEVER = frozenset("nav footer aside form button dialog menu object canvas audio video head".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
#: Elements whose class and id are looked at, and the words there, each a whole one, that name what is never main text.
CONTAINER = frozenset("center details div dl fieldset ol section table ul".split())
NAMED = re.compile(r"ads?|advert\w*|sponsor(?:ed)?|sidebar|side-bar|navbar|nav|navigation|breadcrumbs?|footer|masthead|site-header|page-header|cookies?|cookie-\w+|consent|popup|modal|newsletter|comments?|commentlist|comment-list|disqus|disqus_thread|replies|skip-link", re.I)
#: Names that may also stand on parts of an article.
DOUBTFUL = re.compile(r"promo\w*|banner|menu|notice|subscribe|social|share|sharing|related|recommended|pagination|pager|toolbar|widget", re.I)
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")


def _attributes(source: str) -> dict[str, str]:
    """Names and values; of a name that stands twice the first. A name alone has an empty value."""
    out: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(source) if source.strip(" /") else ():
        out.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    return out


def _article(name: str, a: dict[str, str]) -> str | None:
    """Which mark of a main text the element is, if it is one."""
    role = a.get("role", "").lower()
    return "main" if name == "main" or role == "main" else "article" if name == "article" or role == "article" or a.get("itemprop") == "articleBody" else None


class Open:
    """An open element: where its tag stands, and whether it is left out, an article, or in doubt by its name."""

    __slots__ = ("name", "at", "skip", "main", "doubt")

    def __init__(self, name: str, at: int, skip: bool = False, main: bool = False, doubt: bool = False):
        self.name, self.at, self.skip, self.main, self.doubt = name, at, skip, main, doubt


class Stack:
    """The open elements of a page, from the root inward."""

    def __init__(self) -> None:
        self.open: list[Open] = []
        self.skip = self.main = self.doubt = 0
        self.count: dict[str, int] = {}

    def push(self, e: Open) -> None:
        self.open.append(e)
        self.skip, self.main, self.doubt = self.skip + e.skip, self.main + e.main, self.doubt + e.doubt
        self.count[e.name] = self.count.get(e.name, 0) + 1

    def cut(self, k: int) -> None:
        """End the elements from the k-th on."""
        while len(self.open) > k:
            e = self.open.pop()
            self.skip, self.main, self.doubt = self.skip - e.skip, self.main - e.main, self.doubt - e.doubt
            self.count[e.name] -= 1

    def _innermost(self, names: frozenset[str], border: frozenset[str]) -> int | None:
        if not any(self.count.get(n) for n in names):
            return None
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k].name in names:
                return k
            if self.open[k].name in border:
                return None
        return None

    def starts(self, name: str) -> None:
        """End what a start tag of this name ends."""
        if self.count.get("head") and name not in IN_HEAD:
            self.cut(self._innermost(frozenset(["head"]), frozenset()) or 0)
        if name in ENDS_P and self.count.get("p") and (k := self._innermost(frozenset(["p"]), SCOPE | {"button"})) is not None:
            self.cut(k)
        if name in HEADINGS and self.open and self.open[-1].name in HEADINGS:
            self.cut(len(self.open) - 1)
        if name in IMPLIED and (k := self._innermost(*IMPLIED[name])) is not None:
            self.cut(k)

    def ends(self, name: str) -> None:
        """End the innermost open element of this name, and what is open within it. An end tag without one does nothing."""
        if name in ("html", "body"):  # what follows still belongs to them
            return
        names = HEADINGS if name in HEADINGS else frozenset([name])
        border = frozenset(["table"]) if name in TABLE else SCOPE | {"ol", "ul"} if name == "li" else SCOPE
        if (k := self._innermost(names, border - {name})) is not None:
            self.cut(k)


def _around(page: str) -> set[int]:
    """Places of the tags that enclose the page's first main or its first article."""
    out: set[int] = set()
    seen: set[str] = set()
    stack = Stack()
    for m in PIECE.finditer(page):
        name = (m[3] or "").lower()
        if not name or name in INLINE:
            continue
        if m[2]:
            stack.ends(name)
            continue
        stack.starts(name)
        kind = _article(name, _attributes(m[4]))
        if kind and kind not in seen:
            seen.add(kind)
            out.update(e.at for e in stack.open)
        if name not in VOID and not (m[4].endswith("/") and name not in BLOCK):
            stack.push(Open(name, m.start()))
    return out


def blocks_of(page: str | None) -> tuple[list[tuple[str, bool]], bool]:
    """The page's blocks that may be main text, white space squeezed and references decoded, each with whether it is in
    doubt; whether the page marks its article."""
    if not page:
        return [], False
    found: list[tuple[str, bool, bool]] = []
    held: list[str] = []
    stack = Stack()
    marked = False
    around: set[int] | None = None

    def end_block(inside: bool, unsure: bool) -> None:
        text = " ".join(entities.unescape("".join(held)).split())
        if text:
            found.append((text, inside, unsure))
        held.clear()

    at = 0
    for m in PIECE.finditer(page):
        if m.start() > at:
            text = page[at : m.start()]
            if stack.count.get("head") and stack.open[-1].name == "head" and text.strip():
                stack.ends("head")  # text has no place there
            if not stack.skip:
                held.append(text)
        at = m.end()
        name = (m[3] or "").lower()
        if not name:
            if (m[1] or "").lower() == "xmp" and not stack.skip:
                end_block(bool(stack.main), bool(stack.doubt))
                held.append(entities.escape(re.sub(r"(?is)\A<xmp[^>]*>|</xmp\s*>\Z", "", m[0])))
                end_block(bool(stack.main), bool(stack.doubt))
            continue
        if name == "br":
            if not stack.skip:
                held.append(" ")
            continue
        if name in BLOCK and not stack.skip:
            end_block(bool(stack.main), bool(stack.doubt))
        if m[2]:
            stack.ends(name)
            continue
        stack.starts(name)
        if name in VOID or m[4].endswith("/") and name not in BLOCK:
            continue
        a = _attributes(m[4])
        article = _article(name, a)
        if article and stack.skip:
            # what is left out and is nowhere ended does not swallow the article
            k = next(k for k, e in enumerate(stack.open) if e.skip)
            if not re.compile(rf"</{re.escape(stack.open[k].name)}[\s>]", re.I).search(page, at):
                stack.cut(k)
        if stack.skip:
            if name not in INLINE or stack.count.get(name):
                stack.push(Open(name, m.start()))
            continue
        role = a.get("role", "").lower()
        names = f"{a.get('class', '')} {a.get('id', '')}".split() if name in CONTAINER and not article else ()
        named = any(NAMED.fullmatch(x) for x in names)
        if named and around is None:
            around = _around(page)
        hidden = "hidden" in a and a["hidden"].lower() != "until-found"
        skip = name in NEVER or role in ROLES or name == "header" and not stack.main or hidden or named and m.start() not in (around or ())
        marked = marked or bool(article) and not skip
        if name not in INLINE or skip or article or stack.count.get(name):
            stack.push(Open(name, m.start(), skip, bool(article) and not skip, not skip and any(DOUBTFUL.fullmatch(x) for x in names)))
    if not stack.skip:
        held.append(page[at:])
    end_block(bool(stack.main), bool(stack.doubt))
    return [(t, unsure or not marked) for t, inside, unsure in found if inside or not marked], marked


def covered_blocks(blocks: list[str], spans: list[tuple[int, int]]) -> list[bool]:
    """Which blocks the spans (of bytes of the joined blocks) cover wholly."""
    sizes = [len(b.encode("utf-8", "surrogatepass")) for b in blocks]
    end = np.cumsum([n + 1 for n in sizes])
    covered = np.zeros(int(end[-1]) + 1, dtype=np.int32)
    for s, e in spans:
        covered[s] += 1
        covered[min(e, len(covered) - 1)] -= 1
    inside = np.concatenate(([0], np.cumsum(np.cumsum(covered) > 0)))
    return [bool(inside[e - 1] - inside[e - 1 - n] == n) for n, e in zip(sizes, end.tolist(), strict=True)]


def union_size(spans: list[tuple[int, int]]) -> int:
    """Bytes that the spans cover together."""
    total = at = 0
    for s, e in sorted(spans):
        total, at = total + max(0, e - max(s, at)), max(at, e)
    return total


def spans_of(streams: DataFrame, length: int) -> DataFrame:
    """(id_hash, text_hash, spans) of streams (sid, host, stream): where they have strings that another of the host has."""
    return repeated(streams, length, "sid", "stream", "host", by_text=True).groupBy("id_hash", "text_hash").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def boilerplate(streams: DataFrame, min_shared: int = MIN_SHARED) -> DataFrame:
    """(host, stream, gone) of streams (host, stream, doubts), blocks in lines: hashes of the lines in doubt that are boilerplate.

    doubts says of each line whether it is in doubt, null where none is.
    """

    def with_spans(some: DataFrame, spans: DataFrame) -> DataFrame:
        return written(some.select("*", *hashes("sid", "stream")).join(spans, ["id_hash", "text_hash"]).drop("id_hash", "text_hash"), "shared")

    @F.pandas_udf("array<boolean>")
    def covered(stream: pd.Series, at: pd.Series) -> pd.Series:
        return pd.Series([covered_blocks(t.split("\n"), [(p["start"], p["end"]) for p in s]) for t, s in zip(stream, at, strict=True)])

    @F.pandas_udf("boolean")
    def mostly(stream: pd.Series, at: pd.Series) -> pd.Series:
        return pd.Series([2 * union_size([(p["start"], p["end"]) for p in s]) > len(t.encode("utf-8", "surrogatepass")) for t, s in zip(stream, at, strict=True)])

    named = streams.withColumn("sid", F.xxhash64("host", "stream"))
    own = written(named.where("doubts is not null").groupBy("sid", "host", "stream").agg(F.min("doubts").alias("doubts")), "streams")
    if own.isEmpty():
        return own.select("host", "stream", F.array("sid").alias("gone"))
    shared = with_spans(own, spans_of(own, min_shared))

    # a stream that is a near copy of another shares most of its bytes with it, so the others need not be compared
    alike = written(light(shared, 200).where(mostly("stream", "spans")).select("sid", "stream"), "alike")
    links = link_components(alike.select(F.col("sid").alias("doc_id"), F.col("stream").alias("text")), *COPIES).where("doc_id <> component_id") if not alike.isEmpty() else None
    if links is None or (links := written(links.select(F.col("doc_id").alias("sid"), "component_id").distinct(), "links")).isEmpty():
        known = own.withColumn("component_id", F.col("sid"))
    else:
        known = written(own.join(links, "sid", "left").withColumn("component_id", F.coalesce("component_id", "sid")), "copies")
    first = known.groupBy("host", "component_id").agg(F.min("sid").alias("sid"))
    one = known.join(first.select("sid"), "sid", "left_semi").drop("component_id")

    # of the blocks that shared strings cover those in doubt are searched by themselves; a first line tells equal ones apart
    both = F.zip_with(F.split("stream", "\n"), F.zip_with("doubts", covered("stream", "spans"), lambda d, c: d & c), lambda b, go: F.when(go, b))
    unsure = light(shared, 200).join(first.select("sid"), "sid", "left_semi").select("sid", "host", F.filter(both, lambda b: b.isNotNull()).alias("found")).where(F.size("found") > 0)
    unsure = written(unsure.select("sid", "host", F.concat_ws("\n", F.col("sid").cast("string"), "found").alias("stream")), "unsure")
    hashed = lambda c: F.transform(c, lambda b: F.xxhash64(b))
    if unsure.isEmpty():
        by_string = own.limit(0).select("sid", "host", F.xxhash64("stream").alias("line"))
    else:
        again = light(with_spans(unsure, spans_of(unsure, min_shared)), 200)
        by_string = again.select("sid", "host", F.explode(hashed(F.filter(F.zip_with(F.split("stream", "\n"), covered("stream", "spans"), lambda b, c: F.when(c, b)), lambda b: b.isNotNull()))).alias("line"))

    # lines in doubt of any length that most of a host's pages have
    of_kind = lambda some, unsure: some.select("host", "sid", F.explode(F.array_distinct(hashed(F.filter(F.zip_with(F.split("stream", "\n"), F.coalesce("doubts", F.array().cast("array<boolean>")), lambda b, d: F.when(F.coalesce(d, F.lit(False)) == unsure, b)), lambda b: b.isNotNull())))).alias("line"))
    lines = of_kind(one, True)
    on = lines.groupBy("host", "line").agg(F.count("*").alias("n"))
    of = one.groupBy("host").agg(F.count("*").alias("pages")).where("pages > 2")
    most = on.where("n > 1").join(of, "host").where("2 * n > pages").select("host", "line")
    by_count = lines.join(most, ["host", "line"]).select("sid", "host", "line")
    going = written(by_string.unionByName(by_count).distinct(), "going")
    if going.isEmpty():
        return own.limit(0).select("host", "stream", F.array(F.xxhash64("stream")).alias("gone"))
    # structure of other pages has a say: lines that are an article's on as many pages
    sure = of_kind(named, False).join(going.select("host", "line").distinct(), ["host", "line"], "left_semi").groupBy("host", "line").agg(F.countDistinct("sid").alias("sure"))
    article = sure.join(on, ["host", "line"]).where("sure >= n").select("host", "line")
    gone = going.join(article, ["host", "line"], "left_anti").groupBy("sid").agg(F.collect_set("line").alias("gone"))  # lines of one page
    of_copy = known.join(first.withColumnRenamed("sid", "one"), ["host", "component_id"]).join(gone.withColumnRenamed("sid", "one"), "one")
    return written(of_copy.select("host", "stream", "gone"), "gone")


def shared_bytes(streams: DataFrame, length: int = LONG) -> DataFrame:
    """(id_hash, text_hash, n) of streams (sid, host, stream): bytes covered by strings of this length that another stream of
    the host has too; only streams with such bytes."""

    @F.pandas_udf("long")
    def size(at: pd.Series) -> pd.Series:
        return pd.Series([union_size([(p["start"], p["end"]) for p in s]) for s in at], dtype="int64")

    return written(spans_of(streams, length).select("id_hash", "text_hash", size("spans").alias("n")), "bytes")


def main_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", min_shared: int = MIN_SHARED, shared: str | None = None) -> DataFrame:
    """pages with html replaced by text: the kept blocks joined by blank lines. A column text that they have goes.

    shared: a further column, how many bytes of the page's stream lie in strings of LONG bytes that other pages of the host have.
    """
    others = [c for c in pages.columns if c not in (html, "text", shared)]
    held = [f"c{i}" for i in range(len(others))]  # own names while Python sees the columns, which may hold dots
    schema = StructType([StructField(h, pages.schema[c].dataType) for h, c in zip(held, others, strict=True)]).add("host", StringType()).add("stream", StringType()).add("doubts", ArrayType(BooleanType()))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            found = [blocks_of(p)[0] for p in x.column("html").to_pylist()]
            unsure = [[d for _, d in b] for b in found]
            columns = [pa.array(["\n".join(t for t, _ in b) for b in found], pa.string()), pa.array([d if any(d) else None for d in unsure], pa.list_(pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*(x.column(c) for c in [*held, "host"]), *columns], names=schema.names)

    # one worker a task: every page is parsed once and what was read is written
    named = pages.select(*[F.col(f"`{c}`").alias(h) for h, c in zip(held, others, strict=True)], F.coalesce(host_of(F.col(f"`{url}`")), F.lit("")).alias("host"), F.col(f"`{html}`").alias("html"))
    pages_read = written(light(named, 200).mapInArrow(read, schema), "pages")
    kept = [F.col(h).alias(c) for h, c in zip(held, others, strict=True)]
    if shared:
        named = pages_read.withColumn("sid", F.xxhash64("host", "stream"))
        sizes = shared_bytes(named.select("sid", "host", "stream"))
        sizes = F.broadcast(sizes) if sizes.count() <= MAX_BROADCAST else sizes
        pages_read = named.select("*", *hashes("sid", "stream")).join(sizes, ["id_hash", "text_hash"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
        more = [F.col("n").alias(shared)]
    else:
        more = []
    gone = boilerplate(pages_read.select("host", "stream", "doubts"), min_shared)
    whole = F.replace("stream", F.lit("\n"), F.lit("\n\n"))
    if gone.isEmpty():
        return pages_read.select(*kept, whole.alias("text"), *more)
    # pages without a block in doubt keep all of theirs
    gone = gone.select(F.col("host").alias("_host"), F.xxhash64("stream").alias("_of"), "gone")
    joined = pages_read.where("doubts is not null").withColumn("_host", F.col("host")).withColumn("_of", F.xxhash64("stream")).join(gone, ["_host", "_of"], "left")
    lines = F.zip_with(F.split("stream", "\n"), "doubts", lambda b, d: F.when(~(d & F.coalesce(F.array_contains("gone", F.xxhash64(b)), F.lit(False))), b))
    judged = joined.withColumn("_said", F.array_join(F.filter(lines, lambda b: b.isNotNull()), "\n\n"))
    return pages_read.where("doubts is null").select(*kept, whole.alias("text"), *more).unionByName(judged.select(*kept, F.col("_said").alias("text"), *more))
