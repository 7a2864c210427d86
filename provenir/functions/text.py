"""Profile of a text: words, sentences, paragraphs, language, rhythm and lexical diversity, as columns.

Lengths and offsets are in code points. Means and ratios are rounded half up; the coefficient of variation is formed
from whole-number sums, so that every engine gives the same digits.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules
from .rx import WS, java

WORD = java(rules.WORD)
WINDOW = 50
_STOP_CHARS = max(map(len, (*rules.STOP_FR, *rules.STOP_EN)))
STATS = ("chars", "words", "sentences", "paragraphs", "language", "avg_sentence_length", "sentence_length_cv", "avg_word_length", "em_dash_per_1000", "bullet_line_ratio")


def rounded(x: Column, digits: int = 0) -> Column:
    return F.floor(x * 10**digits + 0.5) / float(10**digits)


def once(c: Column, make: Callable[[Column], Column]) -> Column:
    """make(c) with c evaluated once, however often make uses it."""
    return F.element_at(F.transform(F.array(c), make), 1)


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, f"^[{WS}]+|[{WS}]+\\z", "")


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), 0)


def pieces(text: Column) -> Column:
    """Sentence candidates: split after end marks followed by white space, and at line ends."""
    return F.split(text, f"(?<=[.!?…])[{WS}]+|\\n+")


def paragraphs(text: Column) -> Column:
    return F.filter(F.split(text, f"\\n[{WS}]*\\n"), lambda p: p.rlike(WORD))


def variation(lengths: Column) -> Column:
    """Sample standard deviation by the mean; 0 for fewer than two values or a mean of 0."""
    zero = F.struct(F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("q"))
    sums = F.aggregate(lengths, zero, lambda a, x: F.struct((a.s + x).alias("s"), (a.q + x.cast("long") * x).alias("q")))

    def value(x: Column) -> Column:
        n, s, q = F.size(lengths).cast("double"), x.s.cast("double"), x.q.cast("double")
        return F.when((F.size(lengths) < 2) | (s == 0), 0.0).otherwise(F.sqrt((n * q - s * s) / (n * (n - 1))) / (s / n))

    return once(sums, value)


def language(ws: Column) -> Column:
    head = F.filter(F.slice(ws, 1, 3000), lambda w: F.length(w) <= _STOP_CHARS)  # lower case is never shorter
    lower = F.transform(head, lambda w: F.lower(w))
    share = lambda low, stop: F.size(F.filter(low, lambda w: w.isin(*stop)))
    total = F.greatest(F.lit(1), F.least(F.size(ws), F.lit(3000)))
    named = lambda x: F.when((x.fr / total < 0.06) & (x.en / total < 0.06), "autre").when(x.fr >= x.en, "fr").otherwise("en")
    return once(once(lower, lambda low: F.struct(share(low, rules.STOP_FR).alias("fr"), share(low, rules.STOP_EN).alias("en"))), named)


def profiled(df: DataFrame, text: str = "text") -> DataFrame:
    """df with the columns of STATS; a null text is an empty one. Narrow: no shuffle."""
    t = F.coalesce(F.col(text), F.lit(""))
    x = df.withColumn("_t", t).withColumn("_ws", words(F.col("_t")))
    x = x.withColumn("_lens", F.filter(F.transform(pieces(F.col("_t")), lambda s: F.size(words(s))), lambda n: n >= 3))
    x = x.withColumn("_lines", F.filter(F.split("_t", "\n"), lambda s: s.rlike(f"[^{WS}]")))
    n_words, n_lines = F.size("_ws"), F.size("_lines")
    letters = F.length(F.array_join("_ws", "")).cast("long")
    dashes = F.length("_t") - F.length(F.replace("_t", F.lit(rules.EM_DASH), F.lit("")))
    bullets = F.size(F.filter("_lines", lambda s: s.rlike(java(rules.BULLET))))
    total = F.aggregate("_lens", F.lit(0).cast("long"), lambda a, n: a + n)
    return x.select(
        *df.columns, F.length("_t").cast("long").alias("chars"), n_words.cast("long").alias("words"), F.size("_lens").cast("long").alias("sentences"), F.size(paragraphs(F.col("_t"))).cast("long").alias("paragraphs"), language(F.col("_ws")).alias("language"),
        rounded(F.coalesce(F.try_divide(total, F.size("_lens")), F.lit(0.0)), 1).alias("avg_sentence_length"), rounded(variation(F.col("_lens")), 2).alias("sentence_length_cv"), rounded(F.coalesce(F.try_divide(letters, n_words), F.lit(0.0)), 1).alias("avg_word_length"),
        rounded(F.coalesce(F.try_divide(dashes * 1000, n_words), F.lit(0.0)), 1).alias("em_dash_per_1000"), rounded(F.coalesce(F.try_divide(bullets, n_lines), F.lit(0.0)), 2).alias("bullet_line_ratio"),
    )


def diversity(text: Column, window: int = WINDOW) -> Column:
    """Mean share of distinct words in all windows of `window` words, of all words if fewer; 0 without words. Narrow.

    A word occurrence is the first of its kind in so many windows as its previous occurrence allows; summing these
    gives the mean exactly. Occurrences are sorted by word and place, so each one's previous is its neighbour.
    """
    placed = F.array_sort(F.transform(words(text), lambda w, j: F.struct(F.lower(w).alias("w"), j.alias("j"))))
    before = F.concat(F.slice(placed, 1, 1), F.slice(placed, F.lit(1), F.greatest(F.size(placed) - 1, F.lit(0))))
    both = F.zip_with(before, placed, lambda a, b: F.struct(b.j.alias("j"), F.when((a.w == b.w) & (a.j < b.j), a.j).otherwise(-1).alias("p")))
    zero = F.struct(F.lit(0).cast("long").alias("first"), F.lit(0).cast("long").alias("few"), F.lit(0).alias("n"))

    def value(x: Column, n: Column) -> Column:
        starts = lambda a, p: F.greatest(F.lit(0), F.least(p.j, n - window) - F.greatest(p.p + 1, p.j - (window - 1), F.lit(0)) + 1)
        total = F.aggregate(x, zero, lambda a, p: F.struct((a.first + starts(a, p)).alias("first"), (a.few + (p.p < 0).cast("long")).alias("few"), a.n.alias("n")))
        return F.when(n == 0, 0.0).when(n <= window, total.few / n).otherwise(total.first / (float(window) * (n - (window - 1))))

    held = F.transform(F.array(both), lambda x: value(x, F.size(x)))  # the occurrences are made once, not at each use
    return F.coalesce(rounded(held[0], 2), F.lit(0.0))


def lexical_diversity(df: DataFrame, key: str, text: str = "text", window: int = WINDOW) -> DataFrame:
    """(key, lexical_diversity) for each row of df."""
    return df.select(key, diversity(F.coalesce(F.col(text), F.lit("")), window).alias("lexical_diversity"))


def matches(text: Column, pattern: str) -> Column:
    """Distinct matches, in lower case and with squeezed white space."""
    return F.array_distinct(F.transform(F.filter(F.regexp_extract_all(text, F.lit(pattern), 0), lambda m: m != ""), lambda m: trimmed(F.regexp_replace(F.lower(m), f"[{WS}]+", " "))))


def intervals(text: Column, pattern: str) -> Column:
    """Half-open intervals (start, end) in code points of all matches, in order, without a UDF."""
    return intervals_of(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), 0))


def scanned(values: Column, start: Column, step: Callable[[Column, Column], Column], emit: Callable[[Column, Column], Column], kind: str) -> Column:
    """An array of emit(state, value) along an array, the state going from start by step(state, value) from value to value.

    kind: type of what is emitted. As appending to an array copies it, the values are taken in runs of runs, each of about
    the cubic root of their number: a quarter of a million values take seconds, not an hour.
    """
    typed = lambda depth: F.array().cast("array<" * depth + kind + ">" * depth)

    def run(s: Column, part: Column) -> Column:
        zero = F.struct(s.alias("s"), typed(1).alias("o"))
        return F.aggregate(part, zero, lambda a, x: F.struct(step(a.s, x).alias("s"), F.array_append(a.o, emit(a.s, x)).alias("o")))

    def runs(v: Column, width: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.size(v), F.lit(1)), width), lambda i: F.slice(v, i, width))

    def joined(s: Column, parts: Column, inner: Callable[[Column, Column], Column]) -> Column:
        zero = F.struct(s.alias("s"), typed(2).alias("o"))
        return F.aggregate(parts, zero, lambda a, part: once(inner(a.s, part), lambda r: F.struct(r.s.alias("s"), F.array_append(a.o, r.o).alias("o"))), lambda a: F.struct(a.s.alias("s"), F.flatten(a.o).alias("o")))

    def every(v: Column) -> Column:
        root = F.greatest(F.lit(1), F.ceil(F.cbrt(F.size(v))).cast("int"))
        return once(root, lambda w: joined(start, runs(v, w * w), lambda s, big: joined(s, runs(big, w), run)).o)

    return once(values, every)


def intervals_of(between: Column, found: Column) -> Column:
    """Intervals of the matches of a text, given the text between them and the matches themselves.

    The text between the matches is what splitting at them gives, so the k-th match starts after the first k pieces
    and the k - 1 matches before it.
    """
    pairs = F.zip_with(between, found, lambda p, m: F.struct(F.length(p).alias("p"), F.length(m).alias("m")))  # one piece more than matches
    pairs = F.filter(pairs, lambda x: x["m"].isNotNull())
    place = lambda at, x: F.struct((at + x["p"]).alias("start"), (at + x["p"] + x["m"]).alias("end"))
    return scanned(pairs, F.lit(0), lambda at, x: at + x["p"] + x["m"], place, "struct<start:int,end:int>")


_VERSE_WORD = r"\p{L}[\p{L}'’-]*"


def _without_marks() -> tuple[str, str]:
    """Latin, Greek and Cyrillic letters with marks, and the letters without them, by canonical decomposition."""
    plain = {c: "".join(x for x in unicodedata.normalize("NFD", c) if not unicodedata.combining(x)) for c in map(chr, [*range(0xC0, 0x530), *range(0x1E00, 0x2000)])}
    changed = {c: p for c, p in plain.items() if len(p) == 1 and p != c}
    return "".join(changed), "".join(changed.values())


_MARKS = _without_marks()


def verse(text: Column) -> Column:
    """Whether the text looks like verse: short lines that rhyme or start with capitals."""
    return once(F.filter(F.transform(F.split(text, "\n"), trimmed), lambda s: s != ""), _verse)


def _verse(lines: Column) -> Column:
    n = F.size(lines)
    count = lambda keep: F.size(F.filter(lines, keep))
    size = F.transform(lines, lambda s: F.regexp_count(s, F.lit(_VERSE_WORD)))
    ended = F.transform(lines, lambda s: F.right(F.regexp_replace(F.translate(F.element_at(F.concat(F.array(F.lit("")), F.regexp_extract_all(F.lower(s), F.lit(_VERSE_WORD), 0)), -1), *_MARKS), r"(e?s|e|nt)\z", ""), F.lit(2)))

    def rhymed(ends: Column) -> Column:
        near = lambda i, d: F.try_element_at(ends, i + 1 + d) if d > 0 else F.when(i + d >= 0, F.try_element_at(ends, F.greatest(i + 1 + d, F.lit(1))))
        same = lambda e, i, d: F.coalesce(e == near(i, d), F.lit(False))
        return F.size(F.filter(ends, lambda e, i: (F.length(e) == 2) & (same(e, i, 1) | same(e, i, 2) | same(e, i, -1) | same(e, i, -2))))

    listed = count(lambda s: s.rlike(rf"^([-*•–—>]|[0-9]+[.)])[{WS}]"))
    capitals, stops = count(lambda s: s.rlike(r'^[\p{Lu}«"]')), count(lambda s: s.rlike(r"[.!?]\z"))

    def judged(k: Column) -> Column:
        fits = (k.short >= 0.85 * n) & (k.longest <= 14) & (listed <= 0.3 * n)
        return fits & ((once(ended, rhymed) >= 0.4 * n) | (capitals >= 0.85 * n) & (stops < 0.5 * n) & (k.short >= 0.9 * n))

    sizes = lambda z: F.struct(F.size(F.filter(z, lambda k: (k >= 2) & (k <= 10))).alias("short"), F.array_max(z).alias("longest"))
    return F.coalesce((n >= 6) & once(once(size, sizes), judged), F.lit(False))


def is_prose(line: Column) -> Column:
    """Whether a line is running text rather than a title, table, list of figures or code."""
    return once(trimmed(line), _prose)


def _prose(s: Column) -> Column:
    code = s.rlike(java(r"[{}<>=_\\|#$@`]|\/\/|=>|\(\)|\[\d|\.(?:ts|js|py|json|gguf)\b"))
    prose = F.length(s) - F.length(F.regexp_replace(s, java(r"[\p{L}\s,.;:'’!?«»()\-–]+"), ""))
    digits = F.length(s) - F.length(F.regexp_replace(s, "[0-9]", ""))

    def worded(ws: Column) -> Column:
        plain = F.size(F.filter(ws, lambda w: (F.length(w) >= 4) & (w == F.lower(w))))
        return (F.size(ws) >= 6) & (F.length(F.array_join(ws, "")) >= 3.2 * F.size(ws)) & (plain >= 3)

    return ~s.rlike("^[0-9]") & once(F.regexp_extract_all(s, F.lit(_VERSE_WORD), 0), worded) & ~code & (prose >= 0.9 * F.length(s)) & (digits <= 0.08 * F.length(s))


def prose_sample(text: Column) -> Column:
    """Runs of prose lines joined by spaces, runs joined by blank lines; the text itself under 60 words of prose."""
    marked = F.transform(F.split(text, "\n"), lambda line: once(trimmed(line), lambda s: F.when(_prose(s), F.concat(F.lit("\x01"), s)).otherwise(F.lit("\x02"))))
    joined = F.regexp_replace(F.regexp_replace(F.array_join(marked, ""), "\x02+", "\x02"), "^\x02|\x02\\z", "")
    sample = F.regexp_replace(F.regexp_replace(F.regexp_replace(joined, "\x02\x01", "\n\n"), "^\x01", ""), "\x01", " ")
    return once(sample, lambda x: F.when(F.regexp_count(x, F.lit(_VERSE_WORD)) >= 60, x).otherwise(text))
