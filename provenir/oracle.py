"""DuckDB SQL for the registered queries: the same rules through another engine and another regex dialect."""

from __future__ import annotations

from . import rules
from .functions.rx import WS, re2
from .operators import likelihood
from .queries import MARKERS, RARE


def q(s: str) -> str:
    """A string literal; characters that do not show go through chr()."""
    out = s.replace("'", "''")
    for c in sorted({c for c in out if ord(c) < 32 or ord(c) in (0x200B, 0x202C, 0x202E, 0x202F) or 0xE000 <= ord(c) <= 0xF8FF}):
        out = out.replace(c, f"' || chr({ord(c)}) || '")
    return f"'{out}'" if "||" not in out else f"('{out}')"


def n(pattern: str, flags: str = "", of: str = "t") -> str:
    return f"len(regexp_extract_all({of}, {q(re2(pattern, flags))}))"


def has(of: str, pattern: str, flags: str = "") -> str:
    return f"regexp_matches({of}, {q(re2(pattern, flags))})"


def rounded(x: str, d: int) -> str:
    return f"floor(({x}) * {10**d} + 0.5) / {float(10**d)}"


W = f"[{WS}]"
WORD = q(re2(rules.WORD))


def case(by: int, what: dict[int, str]) -> str:
    return "CASE doc_id % " + str(by) + " " + " ".join(f"WHEN {k} THEN {q(v)}" for k, v in what.items()) + " ELSE '' END"


INJECTED = f"docs AS (SELECT doc_id, lang, coalesce(text, '') || {case(10, MARKERS)} || {case(97, RARE)} AS t FROM documents)"
PLAIN = "docs AS (SELECT doc_id, lang, coalesce(text, '') AS t FROM documents)"


def squeezed(s: str) -> str:
    return rf"regexp_replace(regexp_replace(lower({s}), '{W}+', ' ', 'g'), '^{W}+|{W}+$', '', 'g')"


def language(ws: str) -> str:
    share = lambda stop: f"len(list_filter({ws}[1:3000], lambda w: lower(w) IN ({', '.join(map(q, stop))})))"
    total = f"greatest(1, least(len({ws}), 3000))"
    return f"CASE WHEN {share(rules.STOP_FR)} / {total} < 0.06 AND {share(rules.STOP_EN)} / {total} < 0.06 THEN 'autre' WHEN {share(rules.STOP_FR)} >= {share(rules.STOP_EN)} THEN 'fr' ELSE 'en' END"


def cv(lens: str) -> str:
    s, k, sq = f"CAST(list_sum({lens}) AS DOUBLE)", f"CAST(len({lens}) AS DOUBLE)", f"CAST(list_sum(list_transform({lens}, lambda x: x * x)) AS DOUBLE)"
    return f"CASE WHEN len({lens}) < 2 OR list_sum({lens}) = 0 THEN 0.0 ELSE sqrt(({k} * {sq} - {s} * {s}) / ({k} * ({k} - 1))) / ({s} / {k}) END"


PIECES = rf"regexp_split_to_array(regexp_replace(t, '([.!?…]){W}+', '\1' || chr(1), 'g'), '\x01|\n+')"
PARAGRAPHS = rf"list_filter(regexp_split_to_array(t, '\n{W}*\n'), lambda p: regexp_matches(p, {WORD}))"
#: Statistics of the texts t of the table docs, all other columns of which are kept.
STATS = rf"""parts AS (SELECT *, regexp_extract_all(t, {WORD}) AS ws, list_filter(list_transform({PIECES}, lambda s: len(regexp_extract_all(s, {WORD}))), lambda k: k >= 3) AS lens,
        list_filter(string_split(t, chr(10)), lambda s: regexp_matches(s, '[^{WS}]')) AS lines FROM docs),
    stats AS (SELECT *, length(t) AS chars, len(ws) AS words, len(lens) AS sentences, len({PARAGRAPHS}) AS paragraphs, {language("ws")} AS language,
        {rounded("coalesce(CAST(list_sum(lens) AS DOUBLE) / nullif(len(lens), 0), 0.0)", 1)} AS avg_sentence_length, {rounded(cv("lens"), 2)} AS sentence_length_cv,
        {rounded("coalesce(CAST(length(array_to_string(ws, '')) AS DOUBLE) / nullif(len(ws), 0), 0.0)", 1)} AS avg_word_length,
        {rounded("coalesce(CAST((length(t) - length(replace(t, '—', ''))) * 1000 AS DOUBLE) / nullif(len(ws), 0), 0.0)", 1)} AS em_dash_per_1000,
        {rounded(f"coalesce(CAST(len(list_filter(lines, lambda s: {has('s', rules.BULLET)})) AS DOUBLE) / nullif(len(lines), 0), 0.0)", 2)} AS bullet_line_ratio FROM parts)"""
ALL_RULES = (*rules.ARTEFACTS, rules.MARKDOWN)


def zone(z: str) -> str:
    return f"left(t, {rules.HEAD_CHARS})" if z == "head" else f"right(t, {rules.TAIL_CHARS})" if z == "tail" else "t"


def bounded(words: tuple[str, ...] | str) -> str:
    return rf"\b(?:{words if isinstance(words, str) else '|'.join(words)})\b"


def by_language(english: str, make, fr, en) -> str:
    return f"CASE WHEN {english} THEN {make(en)} ELSE {make(fr)} END"


def style_parts(english: str) -> dict[str, str]:
    starts = f"list_filter(list_transform({PIECES}, lambda s: regexp_replace(s, '^{W}+|{W}+$', '', 'g')), lambda s: s <> '')"
    distinct = lambda w: f"len(list_distinct(list_transform(regexp_extract_all(t, {q(re2(bounded(w), 'i'))}), lambda m: {squeezed('m')})))"
    return {
        "lexicon": by_language(english, lambda w: n(bounded(w), "i"), rules.LEXICON_FR, rules.LEXICON_EN), "distinct": by_language(english, distinct, rules.LEXICON_FR, rules.LEXICON_EN),
        "not_x": by_language(english, lambda p: n(p, "i"), rules.NOT_X_FR.replace(r"(?<![\p{L}])", r"\b"), rules.NOT_X_EN), "starts": f"len({starts})", "transitions": f"len(list_filter({starts}, lambda s: {has('s', rules.TRANSITION)}))",
        "labels": n(rules.LABEL_LIST, "m"), "dashes": "length(t) - length(replace(t, '—', ''))", "casual": by_language(english, lambda b: n(bounded(b), "i"), rules.CASUAL_FR, rules.CASUAL_EN), "punct": n(rules.REPEATED_PUNCTUATION), "lower": n(rules.LOWER_START),
        "double": f"len(list_filter(regexp_extract_all(t, '[^{WS}] +[^ ]'), lambda m: regexp_matches(m, '  +[^{WS}]$')))",
    }


UNICODE = {
    "uni-oai-pua": n(rules.PRIVATE_CITATION), "uni-zero-width": f"({n(rules.ZERO_WIDTH)} + len(regexp_extract_all(substr(t, 2), chr(65279))) + len(regexp_extract_all(t, chr(8205))))",
    "uni-tags": n(rules.TAGS), "uni-vs": n(r"[︀-️]|[\u{E0100}-\u{E01EF}]"), "uni-nnbsp": n(rules.NARROW_SPACE),
    "uni-homoglyph": f"len(list_filter(regexp_extract_all(t, {q(rules.LETTERS)}), lambda w: {has('w', rules.LATIN)} AND {has('w', rules.LOOKALIKE)}))", "uni-bidi": n(rules.BIDI),
}


def vendor_of(s: str) -> str:
    return "CASE " + " ".join(f"WHEN {has(s, p, 'i')} THEN {q(v)}" for p, v in rules.VENDOR_PATTERNS + rules.PUBLISHERS) + " END"


def _vendors(r: rules.Rule) -> str:
    if r.id in rules.FROM_MATCH:
        return f"list_transform(list_distinct(list_filter(list_transform(regexp_extract_all(t, {q(re2(r.pattern, r.flags))}), lambda m: {vendor_of('lower(m)')}), lambda v: v IS NOT NULL)), lambda v: {{'vendor': v, 'weight': {rules.FROM_MATCH_WEIGHT}}})"
    return "[" + ", ".join(f"{{'vendor': '{v}', 'weight': {w}}}" for v, w in r.vendors) + "]" if r.vendors else "CAST([] AS STRUCT(vendor VARCHAR, weight INTEGER)[])"


NO_VENDORS = "CAST([] AS STRUCT(vendor VARCHAR, weight INTEGER)[])"


def _signals() -> str:
    """CTEs up to sig(doc_id, seq, id, category, strength, direction, points, vendors, count)."""
    rows = []
    one = lambda seq, i, cat, strength, direction, points, count, fires, src="s", vendors=NO_VENDORS: rows.append(f"SELECT doc_id, {seq} AS seq, '{i}' AS id, '{cat}' AS category, {strength} AS strength, {direction} AS direction, CAST({points} AS INTEGER) AS points, {vendors} AS vendors, CAST({count} AS BIGINT) AS count FROM {src} WHERE {fires}")
    art = [f"SELECT doc_id, {1000 + i} AS seq, '{r.id}' AS id, '{r.strength}' AS strength, {r.points} AS points, CAST({_vendors(r)} AS STRUCT(vendor VARCHAR, weight INTEGER)[]) AS vendors, CAST({n(r.pattern, r.flags, zone(r.zone))} AS BIGINT) AS count FROM s WHERE {n(r.pattern, r.flags, zone(r.zone))} >= {r.least}" for i, r in enumerate(rules.ARTEFACTS)]
    signatures = ", ".join(f"'{i}'" for i in rules.SIGNATURES)
    quoting = f"quoting AS (SELECT doc_id FROM (SELECT doc_id, unnest(vendors) AS v FROM art WHERE id IN ({signatures})) WHERE v.weight >= 2 GROUP BY doc_id HAVING count(DISTINCT v.vendor) >= {rules.DISCUSSION_VENDORS})"
    totals = "totals AS (SELECT doc_id, sum(points) AS total FROM art GROUP BY doc_id)"
    rows.append("SELECT doc_id, seq, id, 'artefact' AS category, strength, 'ia' AS direction, CAST(points AS INTEGER) AS points, vendors, count FROM art WHERE doc_id NOT IN (SELECT doc_id FROM quoting)")
    rows.append(f"SELECT doc_id, seq, id, 'artefact', 'faible', 'ia', CAST(greatest(1, floor(points * {rules.DISCUSSION_POINTS} / total + 0.5)) AS INTEGER), list_transform(vendors, lambda v: {{'vendor': v.vendor, 'weight': 1}}), count FROM art JOIN quoting USING (doc_id) JOIN totals USING (doc_id)")
    one(1200, "art-discussion", "artefact", "'info'", "'neutre'", 0, "NULL", "true", "quoting")
    m = rules.MARKDOWN
    one(1300, m.id, "artefact", "'moyen'", "'ia'", m.points, n(m.pattern, m.flags), f"{n(m.pattern, m.flags)} >= {m.least}")
    u = {i: f'"{i}"' for i in UNICODE}
    one(2000, "uni-oai-pua", "unicode", "'fort'", "'ia'", 40, u["uni-oai-pua"], f"{u['uni-oai-pua']} > 0", vendors="[{'vendor': 'chatgpt', 'weight': 3}]")
    one(2001, "uni-zero-width", "unicode", "'moyen'", "'ia'", f"CASE WHEN {u['uni-zero-width']} >= 3 THEN 18 ELSE 10 END", u["uni-zero-width"], f"{u['uni-zero-width']} > 0")
    one(2002, "uni-tags", "unicode", "'fort'", "'ia'", 25, u["uni-tags"], f"{u['uni-tags']} > 0")
    one(2003, "uni-vs", "unicode", "'moyen'", "'ia'", 15, u["uni-vs"], f"{u['uni-vs']} > 0")
    one(2004, "uni-nnbsp", "unicode", "'moyen'", "'ia'", 12, u["uni-nnbsp"], f"{u['uni-nnbsp']} >= 2")
    one(2005, "uni-homoglyph", "unicode", f"CASE WHEN {u['uni-homoglyph']} >= 3 THEN 'fort' ELSE 'moyen' END", "'ia'", f"CASE WHEN {u['uni-homoglyph']} >= 3 THEN 30 ELSE 15 END", u["uni-homoglyph"], f"{u['uni-homoglyph']} > 0")
    one(2006, "uni-bidi", "unicode", "'faible'", "'neutre'", 4, u["uni-bidi"], f"{u['uni-bidi']} > 0")
    sty = lambda k, i, points, count, fires, direction="'ia'", strength="'faible'": one(4000 + k, i, "style", strength, direction, points, count, f"words >= 25 AND ({fires})")
    sty(0, "sty-lexicon", "tier", "lexicon", "tier IS NOT NULL", strength="CASE tier WHEN 22 THEN 'moyen' WHEN 2 THEN 'info' ELSE 'faible' END")
    sty(1, "sty-no-lexicon", -4, "NULL", "tier IS NULL AND words >= 300", "'humain'")
    sty(2, "sty-not-x", 8, "not_x", "not_x >= 2 OR not_x = 1 AND words < 300")
    sty(3, "sty-transitions", 8, "transitions", "starts >= 8 AND transitions >= 3 AND transitions * 100 >= starts * 15")
    sty(4, "sty-label-list", 8, "labels", "labels >= 3")
    sty(5, "sty-emdash", 10, "dashes", "em_dash_per_1000 >= 4 AND dashes >= 3")
    sty(6, "sty-casual", -10, "casual", "casual >= 2", "'humain'")
    sty(7, "sty-punct", -5, "punct", "punct >= 2", "'humain'")
    sty(8, "sty-sloppy", -6, "NULL", 'lower >= 3 AND lower * 10 > greatest(sentences, 1) OR "double" >= 3', "'humain'")
    enough, cvs = "words >= 120 AND sentences >= 8", "sentence_length_cv"
    one(5000, "stat-too-short", "stats", "'info'", "'neutre'", 0, "NULL", f"words > 0 AND NOT ({enough})")
    one(5001, "stat-burstiness", "stats", "'faible'", f"CASE WHEN {cvs} > 0.7 THEN 'humain' ELSE 'ia' END", f"CASE WHEN {cvs} < 0.35 THEN 10 WHEN {cvs} < 0.45 THEN 4 ELSE -8 END", "NULL", f"{enough} AND ({cvs} < 0.45 OR {cvs} > 0.7)")
    one(5002, "stat-paragraphs", "stats", "'faible'", "'ia'", 6, "NULL", f"{enough} AND len(sizes) >= 4 AND {cv('sizes')} < 0.25")
    one(5003, "stat-bullets", "stats", "'faible'", "'ia'", 5, "NULL", f"{enough} AND bullet_line_ratio > 0.4")
    one(6000, "watermark-vendor", "watermark", "'info'", "'neutre'", 0, "NULL", "words >= 20")
    parts = ", ".join(f'{e} AS "{k}"' for k, e in style_parts("language = 'en'").items())
    uni = ", ".join(f'{e} AS "{k}"' for k, e in UNICODE.items())
    uni = uni.replace(UNICODE["uni-nnbsp"] + " AS", f"CASE WHEN language = 'fr' THEN len(list_filter(regexp_extract_all(t, '(?:^|[^«0-9])[\\x{{202F}}](?:[^;:!?»%€$0-9]|$)'), lambda m: true)) ELSE {UNICODE['uni-nnbsp']} END AS")
    return f"""{INJECTED}, {STATS},
        p AS (SELECT *, {parts}, {uni}, list_filter(list_transform({PARAGRAPHS}, lambda x: len(regexp_extract_all(x, {WORD}))), lambda k: k >= 15) AS sizes FROM stats),
        s AS MATERIALIZED (SELECT *, CASE WHEN "distinct" >= 6 AND lexicon * 1000 >= 8 * words THEN 22 WHEN "distinct" >= 4 AND lexicon * 1000 >= 5 * words THEN 14 WHEN "distinct" >= 2 THEN 6 WHEN "distinct" = 1 THEN 2 END AS tier FROM p),
        art AS MATERIALIZED ({" UNION ALL ".join(art)}), {quoting}, {totals},
        sig AS MATERIALIZED ({" UNION ALL ".join(rows)})"""


SIGNALS = _signals()
TECH = "category IN ('project', 'metadata', 'artefact', 'unicode')"
FACTOR = "CASE strength WHEN 'fort' THEN 3.0 WHEN 'moyen' THEN 2.0 WHEN 'faible' THEN 1.0 ELSE 0.5 END"
WEIGHTS = f"""hints AS (SELECT doc_id, v.vendor AS vendor, sum(v.weight * CAST({FACTOR} AS DOUBLE)) AS weight, bool_or(v.weight >= 2 AND strength IN ('fort', 'moyen')) AS trace
        FROM (SELECT doc_id, strength, unnest(vendors) AS v FROM sig WHERE direction = 'ia') GROUP BY ALL)"""


def saturated(x: str) -> str:
    return f"CAST(floor(100 * (1 - exp(-greatest(0, {x}) / 30.0)) + 0.5) AS INTEGER)"


VERDICT = f"""sums AS (SELECT doc_id, coalesce(sum(points) FILTER ({TECH}), 0) AS tech, least(45, coalesce(sum(points) FILTER (NOT {TECH}), 0)) AS style,
            coalesce(bool_or(direction = 'ia' AND {TECH} AND strength = 'fort'), false) AS strong, coalesce(bool_or(direction = 'ia' AND {TECH} AND strength = 'moyen'), false) AS medium,
            coalesce(bool_or(direction = 'ia' AND {TECH} AND points > 0), false) AS any_tech, coalesce(bool_or(direction = 'ia' AND points > 0), false) AS any_ia, coalesce(bool_or(direction = 'humain' AND points <> 0), false) AS human
        FROM s LEFT JOIN sig USING (doc_id) GROUP BY doc_id),
    scores AS (SELECT sums.*, s.words, CAST(least(99, greatest(1, floor(100 / (1 + exp(-((tech + CAST(0.6 AS DOUBLE) * style) / CAST(11 AS DOUBLE) - 2))) + 0.5))) AS INTEGER) AS score FROM sums JOIN s USING (doc_id)),
    judged AS (SELECT *, NOT strong AND NOT medium AND NOT human AND (NOT any_ia OR words < 80 AND score < 50) AS undetermined, {saturated("tech")} AS technical_score, {saturated("style")} AS style_score FROM scores),
    final AS (SELECT doc_id, score, technical_score, style_score, undetermined,
            CASE WHEN undetermined THEN 'Indéterminable : aucune trace exploitable' WHEN score >= 85 AND strong THEN 'Généré par IA, trace technique détectée' WHEN score >= 85 OR score >= 70 AND any_tech THEN 'Très probablement généré par IA'
                 WHEN score >= 50 THEN 'Probablement généré ou retravaillé par IA' WHEN score >= 30 THEN 'Indices faibles, impossible de conclure' ELSE 'Aucun indice d''IA détecté' END AS verdict,
            CASE WHEN undetermined THEN 'faible' WHEN strong THEN 'élevée' WHEN medium THEN 'moyenne' WHEN words < 150 THEN 'faible' WHEN style_score >= 60 OR style_score <= 10 THEN 'moyenne' ELSE 'faible' END AS confidence FROM judged)"""
_VENDOR_LIST = ", ".join(f"('{v}')" for v in rules.AI_VENDORS)
_RANK = lambda c, names: f"list_position([{', '.join(repr(x) for x in names)}], {c})"
_STATS_OUT = "CAST(chars AS BIGINT) AS chars, CAST(words AS BIGINT) AS words, CAST(sentences AS BIGINT) AS sentences, CAST(paragraphs AS BIGINT) AS paragraphs, language, avg_sentence_length, sentence_length_cv, avg_word_length, em_dash_per_1000, bullet_line_ratio"


def _rule_table(columns: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT '{i}' AS rule, CAST(sum({e}) AS BIGINT) AS matches, CAST(count(*) FILTER ({e} > 0) AS BIGINT) AS documents FROM docs" for i, e in columns.items())


_HTML = "html"
for _p, _to in ((r'(?s)<sup[^>]*class="[^"]*reference[^"]*"[^>]*>.*?</sup>', ""), (r"(?s)<style.*?</style>", ""), (r"(?s)<script.*?</script>", ""), (r"<[^>]+>", " "), ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&"), (r"\[[0-9]+\]", ""), (f"{W}+", " ")):
    _HTML = f"regexp_replace({_HTML}, '{_p}', '{_to}', 'g')"

SQL: dict[str, str] = {
    "text_stats": f"WITH {PLAIN}, {STATS} SELECT doc_id, {_STATS_OUT} FROM stats",
    "mattr": f"""WITH {PLAIN}, w AS (SELECT doc_id, unnest(list_transform(regexp_extract_all(t, {WORD}), lambda x: lower(x))) AS w, generate_subscripts(regexp_extract_all(t, {WORD}), 1) - 1 AS j FROM docs),
        p AS (SELECT doc_id, j, coalesce(lag(j) OVER (PARTITION BY doc_id, w ORDER BY j), -1) AS p, count(*) OVER (PARTITION BY doc_id) AS n FROM w),
        d AS (SELECT doc_id, max(n) AS n, count(*) FILTER (p < 0) AS few, sum(greatest(0, least(j, n - 50) - greatest(p + 1, j - 49, 0) + 1)) AS starts FROM p GROUP BY doc_id)
        SELECT doc_id, coalesce({rounded("CASE WHEN n <= 50 THEN few / n ELSE CAST(starts AS DOUBLE) / (CAST(50 AS DOUBLE) * (n - 49)) END", 2)}, 0.0) AS lexical_diversity FROM docs LEFT JOIN d USING (doc_id)""",
    "language_confusion": f"WITH {PLAIN}, w AS (SELECT lang, regexp_extract_all(t, {WORD}) AS ws FROM docs) SELECT lang, {language('ws')} AS language, count(*) AS n FROM w GROUP BY ALL",
    "conversation_profile": f"WITH docs AS (SELECT role, coalesce(text, '') AS t FROM conversations), {STATS} SELECT role, count(*) AS turns, CAST(sum(words) AS BIGINT) AS words, CAST(sum(sentences) AS BIGINT) AS sentences, CAST(max(chars) AS BIGINT) AS longest FROM stats GROUP BY role",
    "artefact_rule_counts": f"WITH {INJECTED} " + _rule_table({r.id: n(r.pattern, r.flags, zone(r.zone)) for r in ALL_RULES}),
    "unicode_rule_counts": f"WITH {INJECTED} " + _rule_table(UNICODE),
    "style_counts": f"WITH {INJECTED} SELECT doc_id, " + ", ".join(f'CAST({e} AS BIGINT) AS "{k}"' for k, e in style_parts("lang = 'en'").items() if k != "starts") + " FROM docs",
    "signals_long": f"WITH {SIGNALS} SELECT doc_id, id, category, strength, direction, points, count FROM sig",
    "signals_by_category": f"WITH {SIGNALS} SELECT category, direction, count(*) AS n, CAST(sum(points) AS BIGINT) AS points FROM sig GROUP BY ROLLUP (category, direction)",
    "top_signals": f"WITH {SIGNALS}, r AS (SELECT doc_id, id, points, row_number() OVER (PARTITION BY doc_id ORDER BY {_RANK('category', rules.CATEGORIES)}, {_RANK('strength', rules.STRENGTHS)}, -points, seq) - 1 AS place FROM sig) SELECT doc_id, place, id, points FROM r WHERE place < 3",
    "vendor_attribution": f"WITH {SIGNALS}, {WEIGHTS} SELECT doc_id, vendor, CAST(least(100, floor(weight * 8 + 0.5)) AS INTEGER) AS score, CASE WHEN trace THEN 'trace' ELSE 'indice' END AS level FROM hints",
    "origin_shares": f"""WITH {SIGNALS}, {VERDICT}, {WEIGHTS}, traced AS (SELECT DISTINCT doc_id FROM hints WHERE trace),
        w AS (SELECT f.doc_id, v.vendor, CASE WHEN f.undetermined THEN NULL ELSE f.score / 100.0::DOUBLE END AS p, CASE WHEN f.doc_id IN (SELECT doc_id FROM traced) THEN CASE WHEN h.trace THEN h.weight ELSE 0 END ELSE 1 + coalesce(h.weight, 0) END AS w
              FROM final f CROSS JOIN (VALUES {_VENDOR_LIST}) v(vendor) LEFT JOIN hints h ON h.doc_id = f.doc_id AND h.vendor = v.vendor)
        SELECT doc_id, vendor, CAST(floor(p * (w / sum(w) OVER (PARTITION BY doc_id)) * 100 + 0.5) AS INTEGER) AS score FROM w""",
    "quote_mode": f"WITH {SIGNALS} SELECT doc_id, CAST(sum(points) AS BIGINT) AS points, count(*) AS signals FROM sig JOIN quoting USING (doc_id) WHERE category = 'artefact' AND id <> 'art-markdown' GROUP BY doc_id",
    "verdict_score": f"WITH {SIGNALS}, {VERDICT} SELECT * FROM final",
    "verdict_distribution": f"WITH {SIGNALS}, {VERDICT} SELECT verdict, confidence, count(*) AS n, min(score) AS least, max(score) AS most FROM final GROUP BY ALL",
    "docs_signals_labels": f"WITH {SIGNALS}, {VERDICT} SELECT quality, toxic, count(*) AS n, count(*) FILTER (score >= 50) AS flagged FROM final JOIN labels USING (doc_id) GROUP BY ALL",
    "scan_markdown": f"WITH {INJECTED} SELECT doc_id, CAST({n(rules.MARKDOWN.pattern, 'm')} AS BIGINT) AS matches, CAST(len(list_distinct(list_transform(regexp_extract_all(t, {q(re2(rules.MARKDOWN.pattern, 'm'))}), lambda m: {squeezed('m')}))) AS BIGINT) AS distinct_matches FROM docs",
    "scan_offsets": f"""WITH {INJECTED}, m AS (SELECT doc_id, regexp_split_to_array(t, {q(re2(rules.REPEATED_PUNCTUATION))}) AS a, regexp_extract_all(t, {q(re2(rules.REPEATED_PUNCTUATION))}) AS b FROM docs),
        k AS (SELECT doc_id, a, b, unnest(range(len(b))) AS k FROM m)
        SELECT doc_id, k, CAST(length(array_to_string(a[1:k + 1], '')) + length(array_to_string(b[1:k], '')) AS BIGINT) AS start, CAST(length(array_to_string(a[1:k + 1], '')) + length(array_to_string(b[1:k + 1], '')) AS BIGINT) AS stop FROM k""",
    "clean_utm": r"""WITH u AS (SELECT page_id, replace(url, 'utm_source=feed', 'utm_source=chatgpt.com') || CASE WHEN page_id % 3 = 0 THEN '&utm_source=openai&z=1' ELSE '' END AS u FROM pages),
        v AS (SELECT page_id, regexp_replace(u, '(?i)([?&])utm_source=(?:chatgpt\.com|openai|perplexity(?:\.ai)?|copilot(?:\.com)?|gemini|claude(?:\.ai)?|bard|you\.com|mistral|deepseek|grok)&|[?&]utm_source=(?:chatgpt\.com|openai|perplexity(?:\.ai)?|copilot(?:\.com)?|gemini|claude(?:\.ai)?|bard|you\.com|mistral|deepseek|grok)', '\1', 'g') AS v FROM u)
        SELECT page_id, regexp_replace(v, '[?&]$', '') AS url FROM v""",
    "html_prose": f"SELECT page_id, md5(regexp_replace({_HTML}, '^{W}+|{W}+$', '', 'g')) AS prose_md5 FROM pages",
    "report_summary": f"SELECT doc_id, regexp_replace(regexp_replace(left(text, 140), '{W}+', ' ', 'g'), '^{W}+|{W}+$', '', 'g') AS excerpt FROM documents",
}


def logits(scale: float, name: str) -> str:
    """CTEs words and `name`: the token distributions that the queries make."""
    return f"""{name} AS (SELECT doc_id, pos, n, pos + length(ws[pos + 1]) % least(4, n - pos) AS actual, list_transform(range(least(4, n - pos)), lambda j: -(0.7::DOUBLE * j + 0.03::DOUBLE * (length(ws[pos + j + 1]) % 5) * j) * {scale}::DOUBLE) AS l
        FROM (SELECT *, unnest(range(n)) AS pos FROM (SELECT doc_id, ws, len(ws) AS n FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {WORD}) AS ws FROM documents))))"""


def positions(name: str) -> str:
    z = "(l[1] + ln(3.5::DOUBLE))"
    m = f"list_sum(list_transform(l, lambda x: exp(x - {z})))"
    s1 = f"list_sum(list_transform(l, lambda x: exp(x - {z}) * (x - {z})))"
    s2 = f"list_sum(list_transform(l, lambda x: exp(x - {z}) * (x - {z}) * (x - {z})))"
    tail = f"(1 - {m})"
    lp = f"ln({tail} / (1000 - len(l)))"
    return f"""{name}_s AS (SELECT doc_id, pos, n, l[actual - pos + 1] - {z} AS log_prob, {s1} + CASE WHEN {tail} > 1e-9 THEN {tail} * {lp} ELSE 0 END AS mean, {s2} + CASE WHEN {tail} > 1e-9 THEN {tail} * {lp} * {lp} ELSE 0 END AS q FROM {name}),
        {name}_p AS (SELECT doc_id, pos, n, log_prob, mean, greatest(0, q - mean * mean) AS variance FROM {name}_s)"""


SAMPLES = """samples AS (SELECT doc_id AS sample_id, quality = 1 AS ai, 1 + doc_id % 3 AS weight, 20 + n_chars % 230 AS tokens, -2.0::DOUBLE - (n_chars % 101) / 100.0::DOUBLE AS mean_log_prob, 2.0::DOUBLE + (n_chars % 37) / 37.0::DOUBLE AS mean_entropy,
        ((n_chars % 53) - 26) / 10.0::DOUBLE AS criterion, CASE WHEN doc_id % 5 <> 0 THEN 0.9::DOUBLE + (n_chars % 71) / 200.0::DOUBLE END AS binoculars, lang, source FROM documents JOIN labels USING (doc_id))"""
_FEATURE = {"criterion_per_token": "criterion / sqrt(tokens::DOUBLE)", "log_tokens": "ln(least(tokens, 240)::DOUBLE)"}


def raw(f: dict) -> str:
    return f"({f['bias']}::DOUBLE" + "".join(f" + ({w})::DOUBLE * ({_FEATURE.get(k, k)} - ({m})::DOUBLE) / ({sd})::DOUBLE" for k, (m, sd, w) in f["features"].items()) + ")"


def offset(t: tuple) -> str:
    parts = [f"WHEN tokens <= {t[0][0]} THEN {t[0][1]}::DOUBLE"] + [f"WHEN tokens <= {b} THEN {x}::DOUBLE + (ln(tokens::DOUBLE) - ln({a}::DOUBLE)) / (ln({b}::DOUBLE) - ln({a}::DOUBLE)) * ({y}::DOUBLE - {x}::DOUBLE)" for (a, x), (b, y) in zip(t, t[1:], strict=False)]
    return "CASE " + " ".join(parts) + f" ELSE {t[-1][1]}::DOUBLE END"


T, B = likelihood.THREE_MEASURES, likelihood.BINOCULARS
SCORED = f"""{SAMPLES}, logit AS (SELECT *, greatest(-3.5::DOUBLE, least(3.5::DOUBLE, CASE WHEN binoculars IS NOT NULL AND tokens >= 50 THEN {raw(B)} - {offset(B['thresholds'])} ELSE {raw(T)} - {offset(T['thresholds'])} END)) AS logit FROM samples),
    scored AS (SELECT *, 1 / (1 + exp(-logit)) AS p, greatest(0, least(1, (tokens - 20) / 40.0::DOUBLE)) AS r, {rounded('logit', 6)} AS score, {rounded('logit', 6)} > 0 AS flag, CASE WHEN tokens * 2 <= 80 THEN 30 WHEN tokens * 2 <= 130 THEN 50 WHEN tokens * 2 <= 200 THEN 80 WHEN tokens * 2 <= 320 THEN 120 ELSE 200 END AS bucket FROM logit)"""
RATES = f"""rates AS (SELECT bucket, {rounded('sum(weight) FILTER (ai AND flag)::DOUBLE / sum(weight) FILTER (ai)', 2).replace('sum(weight) FILTER (ai AND flag)', 'coalesce(sum(weight) FILTER (ai AND flag), 0)')} AS detected,
        {rounded('coalesce(sum(weight) FILTER (NOT ai AND flag), 0)::DOUBLE / sum(weight) FILTER (NOT ai)', 2)} AS false_positives FROM scored GROUP BY bucket HAVING detected IS NOT NULL AND false_positives IS NOT NULL)"""

SQL |= {
    "token_stats": f"WITH {logits(1.0, 'o')}, {positions('o')} SELECT doc_id, count(*) AS positions, {rounded('avg(log_prob)', 6)} AS log_prob, {rounded('avg(mean)', 6)} AS mean, {rounded('avg(variance)', 6)} AS variance FROM o_p GROUP BY doc_id",
    "prefix_measures": f"""WITH {logits(1.0, 'o')}, {logits(0.8, 'f')}, {positions('f')},
        x AS (SELECT f.doc_id, f.pos, list_sum(list_transform(range(1, len(o.l) + 1), lambda i: -exp(o.l[i] - o.l[1]) / list_sum(list_transform(o.l, lambda y: exp(y - o.l[1]))) * (f.l[i] - (f.l[1] + ln(3.5::DOUBLE))))) AS x_ppl FROM o JOIN f USING (doc_id, pos)),
        m AS (SELECT p.*, x_ppl, unnest(list_distinct([least(30, n + 1), least(50, n + 1), least(200, n + 1)])) AS size FROM f_p p LEFT JOIN x USING (doc_id, pos)),
        g AS (SELECT doc_id, size, count(*) AS k, sum(log_prob) AS lp, sum(mean) AS m, sum(variance) AS v, avg(-log_prob) FILTER (x_ppl IS NOT NULL) AS a, avg(x_ppl) AS b FROM m WHERE pos < size - 1 GROUP BY doc_id, size)
        SELECT doc_id, CAST(size AS BIGINT) AS size, k + 1 AS tokens, {rounded('lp / k', 6)} AS mean_log_prob, {rounded('-m / k', 6)} AS mean_entropy, {rounded('(lp - m) / sqrt(v)', 6)} AS criterion, {rounded('a / nullif(b, 0)', 6)} AS binoculars FROM g WHERE v > 0""",
    "calibration_score": f"""WITH {SCORED}, s AS (SELECT *, CAST(greatest(-5, floor(11 * r * logit + 0.5)) AS INTEGER) AS pts FROM scored)
        SELECT sample_id, {rounded('logit', 6)} AS logit, {rounded('p', 6)} AS probability, r AS reliability, CASE WHEN r = 0 THEN 0 ELSE pts END AS points,
            CASE WHEN r = 0 THEN 'info' WHEN p > 0.9 AND r = 1 THEN 'fort' WHEN abs(pts) >= 8 THEN 'moyen' ELSE 'faible' END AS strength, CASE WHEN r = 0 OR abs(pts) < 3 THEN 'neutre' WHEN p >= 0.5 THEN 'ia' ELSE 'humain' END AS direction FROM s""",
    "weighted_threshold": f"WITH {SCORED}, c AS (SELECT bucket, score, sum(weight) OVER (PARTITION BY bucket ORDER BY score, sample_id ROWS UNBOUNDED PRECEDING) AS c, sum(weight) OVER (PARTITION BY bucket) AS a FROM scored WHERE NOT ai) SELECT bucket, min(score) AS offset FROM c WHERE c >= 0.95::DOUBLE * a GROUP BY bucket",
    "bucket_rates": f"WITH {SCORED}, {RATES} SELECT * FROM rates",
    "rates_by_group": f"WITH {SCORED} SELECT lang, source, count(*) AS n, count(*) FILTER (flag) AS flagged FROM scored WHERE tokens >= 80 GROUP BY GROUPING SETS ((lang), (source), ())",
    "rate_at": f"WITH {SCORED}, {RATES}, first AS (SELECT detected FROM rates ORDER BY bucket LIMIT 1) SELECT sample_id, coalesce(rates.detected, (SELECT detected FROM first)) AS detected FROM samples ASOF LEFT JOIN rates ON tokens >= bucket",
    "measure_band_join": f"WITH {SAMPLES}, b AS (SELECT sample_id, k AS ord, tokens + k * 2 - 5 AS b_tokens FROM samples, range(4) r(k)), j AS (SELECT a.sample_id, a.tokens, b_tokens, row_number() OVER (PARTITION BY a.sample_id ORDER BY ord) AS place FROM samples a LEFT JOIN b ON a.sample_id = b.sample_id AND abs(b_tokens - tokens) <= 2) SELECT sample_id, tokens, b_tokens FROM j WHERE place = 1",
    "resume_anti_join": "SELECT doc_id FROM documents ANTI JOIN labels USING (doc_id)",
    "samples_union": f"WITH {SAMPLES}, u AS (SELECT sample_id AS g, ai, weight FROM samples UNION ALL SELECT (SELECT max(sample_id) FROM samples) + sample_id + 1, ai, 5 FROM samples WHERE sample_id % 7 = 0) SELECT ai, count(*) AS n, CAST(sum(weight) AS BIGINT) AS weight, count(DISTINCT g) AS texts FROM u GROUP BY ai",
    "history_top200": "SELECT doc_id, 1700000000 + (doc_id * 7919) % 100003 AS created FROM documents ORDER BY created DESC, doc_id DESC LIMIT 200",
    "answers_upsert": "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'ai' WHEN toxic = 1 THEN 'ai' ELSE 'human' END AS label FROM labels WHERE doc_id % 6 <> 0",
    "event_windows": "SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS start, event_type, count(*) AS n FROM events GROUP BY ALL",
}
