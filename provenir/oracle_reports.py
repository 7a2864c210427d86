"""DuckDB SQL for the queries of files, projects, reports and recalibration, written as sets of rows rather than arrays."""

from __future__ import annotations

from . import rules
from .functions import clean
from .functions.rx import WS, re2
from .operators import corpus, explain, files, software
from .oracle import FACTOR, INJECTED, PIECES, PLAIN, SAMPLES, SIGNALS, STATS, VERDICT, W, WEIGHTS, WORD, has, n, q, rounded, squeezed
from .queries_reports import CODE, COMMITS, MADE, PATHS

_KEYS = sorted({k for m in MADE.values() for k in m} - {"kind"})


def _case(modulus: int, what: dict, default: str = "NULL") -> str:
    return f"CASE doc_id % {modulus} " + " ".join(f"WHEN {k} THEN {q(v)}" for k, v in what.items()) + f" ELSE {default} END"


def _at(key: str) -> str:
    return f'"{key}"' if key in _KEYS else "CAST(NULL AS VARCHAR)"


def _is(value: str, pattern: str) -> str:
    return f"coalesce({has(value, pattern, 'i')}, false)"


FILES = "files AS (SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), " + WORD + f")) AS words, {_case(16, {i: m['kind'] for i, m in MADE.items()}, q('text'))} AS kind, " + ", ".join(f'{_case(16, {i: m[k] for i, m in MADE.items() if k in m})} AS "{k}"' for k in _KEYS) + " FROM documents)"
VENDOR = lambda s: "CASE " + " ".join(f"WHEN {has(s, p, 'i')} THEN {q(v)}" for p, v in rules.VENDOR_PATTERNS) + " END"
#: Facts that may name an assistant, and how.
_NAMED = [("pdf.producer", "tool"), ("pdf.creator", "tool"), ("pdf.author|docx.creator", "person"), ("pdf.title|docx.title", "content"), ("pdf.subject", "content"), ("pdf.keywords", "content"), ("xmp.creatortool", "tool"), ("docx.lastmodifiedby", "person"), ("docx.description", "content"), ("docx.application", "tool"), ("docx.company", "tool"), ("docx.template", "tool"), ("docx.custom", "tool"), ("c2pa.generator", "tool")]
_ROWS = " UNION ALL ".join(f"SELECT doc_id, coalesce({', '.join(_at(k) for k in keys.split('|'))}) AS v, '{how}' AS how FROM files WHERE kind IN ('pdf', 'docx')" for keys, how in _NAMED)
_TOOL = "concat_ws(' · ', " + ", ".join(_at(k) for k in ("pdf.producer", "pdf.creator", "xmp.creatortool", "xmp.producer")) + ")"
_UTC = f"""regexp_matches(regexp_replace(coalesce({_at('pdf.creationdate')}, ''), '\\s', '', 'g'), {q(files.UTC_DATE)})"""
_HEADLESS = f"({_is(_at('pdf.creator'), 'headlesschrome|puppeteer|playwright')} AND {_is(_at('pdf.creator'), 'linux')} AND {_UTC})"
_FIRST = "CASE " + " ".join(f"WHEN {_is('tool', g[0])} THEN {i}" for i, g in enumerate(files.GENERATORS)) + f" WHEN {_at('pdf.reportlab')} = '1' THEN 0 END"
_LIB = "CASE " + " ".join("WHEN " + " OR ".join(_is(_at(k), p) for k in ("docx.creator", "docx.lastmodifiedby", "docx.description", "docx.application")) + f" THEN {i}" for i, (p, _) in enumerate(files.LIBRARIES)) + " END"


def _hints(pairs: tuple) -> str:
    return "[" + ", ".join(f"{{'vendor': '{v}', 'weight': {w}}}" for v, w in pairs) + "]" if pairs else "CAST([] AS STRUCT(vendor VARCHAR, weight INTEGER)[])"


def _one(seq: int, id_: str, strength: str, direction: str, points: str, vendors: str, where: str, source: str = "f") -> str:
    return f"SELECT doc_id, {seq} AS seq, '{id_}' AS id, {strength} AS strength, {direction} AS direction, CAST({points} AS INTEGER) AS points, CAST({vendors} AS STRUCT(vendor VARCHAR, weight INTEGER)[]) AS vendors FROM {source} WHERE {where}"


_G = lambda k: "CASE rule " + " ".join(f"WHEN {i} THEN {k(g)}" for i, g in enumerate(files.GENERATORS)) + " END"
_WORDLIKE = _is("app", "word|libreoffice|openoffice|pages|wps|onlyoffice|google")
_MINUTES = f"TRY_CAST({_at('docx.totaltime')} AS DOUBLE)"
_MARKS = f"TRY_CAST({_at('docx.rsids')} AS INTEGER)"
_PACE = f"words / greatest({_MINUTES}, 1.0)"
META = f"""{FILES}, fields AS ({_ROWS}),
    names AS (SELECT doc_id, {VENDOR('v')} AS vendor, how <> 'content' OR {_is('v', files.EXPORT_TITLE)} AS strong FROM fields
        WHERE v <> '' AND (how <> 'person' OR {_is('v', files.EXACT_NAME)}) AND (how <> 'content' OR {_is('v', files.EXPORT_TITLE)} OR {_is('v', files.CONTENT_NAME)} OR {_is('v', files.OTHER_TOOLS)}) AND ({VENDOR('v')} IS NOT NULL OR {_is('v', files.OTHER_TOOLS)})),
    per_vendor AS (SELECT doc_id, vendor, max(CASE WHEN strong THEN 3 ELSE 1 END) AS weight FROM names WHERE vendor IS NOT NULL GROUP BY ALL),
    named AS (SELECT doc_id, bool_or(strong) AS strong, coalesce((SELECT list({{'vendor': p.vendor, 'weight': p.weight}} ORDER BY p.vendor) FROM per_vendor p WHERE p.doc_id = names.doc_id), []) AS vendors FROM names GROUP BY doc_id),
    tools AS (SELECT *, {_TOOL} AS tool, coalesce({_at('docx.application')}, '') AS app, {VENDOR(_at('c2pa.generator'))} AS gen FROM files),
    f AS (SELECT *, {_FIRST} AS rule, {_HEADLESS} AS headless, {_LIB} AS lib FROM tools),
    meta AS ({_one(500, 'meta-ai-name', "CASE WHEN strong THEN 'fort' ELSE 'moyen' END", "'ia'", "CASE WHEN strong THEN 40 ELSE 12 END", 'vendors', 'true', 'named')}
        UNION ALL {_one(501, 'meta-iptc-ai', "'fort'", "'ia'", '45', _hints(()), f"kind IN ('pdf', 'docx') AND {_is(_at('xmp.digitalsourcetype'), files.AI_SOURCE)}")}
        UNION ALL {_one(502, 'meta-c2pa', "CASE WHEN gen IS NULL THEN 'moyen' ELSE 'fort' END", "'ia'", 'CASE WHEN gen IS NULL THEN 15 ELSE 35 END', "CASE WHEN gen IS NULL THEN [] ELSE [{'vendor': gen, 'weight': 3}] END", f"kind IN ('pdf', 'docx') AND {_at('c2pa')} = '1'")}
        UNION ALL {_one(503, 'meta-pdf-generator', _G(lambda g: q(g[2])), _G(lambda g: q(g[3])), _G(lambda g: g[1]), _G(lambda g: _hints(g[4])), f"kind = 'pdf' AND rule IS NOT NULL AND (NOT headless OR {_G(lambda g: g[1])} > 5)")}
        UNION ALL {_one(504, 'meta-pdf-defaults', "'moyen'", "'ia'", '8', _hints((('script', 2),)), "kind = 'pdf' AND (" + ' + '.join(f"CAST({_is(_at(k), p)} AS INTEGER)" for k, p in (('pdf.author', r'^[(]?anonymous[)]?$'), ('pdf.title', r'^[(]?(untitled|anonymous)[)]?$'), ('pdf.subject', r'^[(]?unspecified[)]?$'), ('pdf.creator', r'^[(]?unspecified[)]?$'))) + ") >= 2")}
        UNION ALL {_one(505, 'meta-headless-sandbox', "'moyen'", "'ia'", '10', _hints((('script', 2), ('claude', 1), ('chatgpt', 1))), "kind = 'pdf' AND headless")}
        UNION ALL {_one(506, 'meta-pdf-utc', "'faible'", "'ia'", '5', _hints(()), f"kind = 'pdf' AND {_UTC} AND NOT {_is('tool', 'microsoft|word|pages|quartz')} AND NOT headless")}
        UNION ALL {_one(507, 'meta-pdf-empty', "'info'", "'neutre'", '2', _hints(()), f"kind = 'pdf' AND tool = '' AND {_at('pdf.author')} IS NULL AND {_at('pdf.title')} IS NULL")}
        UNION ALL {_one(508, 'meta-docx-lib', "'fort'", "'ia'", '32', 'CASE lib ' + ' '.join(f'WHEN {i} THEN {_hints(v)}' for i, (_, v) in enumerate(files.LIBRARIES)) + ' END', "kind = 'docx' AND lib IS NOT NULL")}
        UNION ALL {_one(509, 'meta-docx-noapp', "'moyen'", "'ia'", '10', _hints((('script', 1),)), f"kind = 'docx' AND ({_at('docx.hasapp')} = '0' OR app = '')")}
        UNION ALL {_one(510, 'meta-docx-paste', "'moyen'", "'ia'", '12', _hints(()), f"kind = 'docx' AND lib IS NULL AND {_WORDLIKE} AND words >= 200 AND {_PACE} > 120")}
        UNION ALL {_one(510, 'meta-docx-worked', "'faible'", "'humain'", '-8', _hints(()), f"kind = 'docx' AND lib IS NULL AND {_WORDLIKE} AND words >= 200 AND {_PACE} < 20 AND {_MINUTES} >= 20")}
        UNION ALL {_one(511, 'meta-docx-norsid', "'moyen'", "'ia'", '10', _hints((('script', 1),)), f"kind = 'docx' AND lib IS NULL AND {_is('app', 'word')} AND {_MARKS} = 0")}
        UNION ALL {_one(511, 'meta-docx-sessions', "'faible'", "'humain'", '-6', _hints(()), f"kind = 'docx' AND lib IS NULL AND {_is('app', 'word')} AND {_MARKS} >= 6")})"""

_KNOWN = lambda v, what: "CASE " + " ".join(f"WHEN {has(v, p, 'i')} THEN {q(x) if (x := (name if what == 'name' else note)) else 'NULL'}" for p, name, note in software.KNOWN) + " END"
_SOFT = " UNION ALL ".join(f"SELECT doc_id, {i} AS ord, {_at(k)} AS v, {q(label)} AS label, {str(person).lower()} AS person, {'template' if k == 'docx.application' else 'false'} AS inherited FROM tpl" for i, (k, label, person) in enumerate(software.FIELDS))
SOFTWARE = f"""tpl AS (SELECT *, {_is(_at('docx.creator'), 'python-docx')} OR {_is(_at('docx.description'), 'python-docx')} AS template FROM files WHERE kind IN ('pdf', 'docx')),
    cand AS (SELECT *, {_KNOWN('v', 'name')} AS known, {_KNOWN('v', 'note')} AS known_note FROM ({_SOFT}) WHERE v <> '' AND NOT {_is('v', software.PLACEHOLDER)}),
    hint AS (SELECT doc_id, ord, coalesce(known, left(trim(regexp_replace(v, '{W}+', ' ', 'g')), 40)) AS name, CASE WHEN inherited THEN 10 ELSE 95 END AS confidence, label || ' : « ' || left(v, 60) || ' »' || CASE WHEN inherited THEN {q(software.TEMPLATE)} ELSE '' END AS source, CASE WHEN NOT inherited THEN known_note END AS note
        FROM cand WHERE known IS NOT NULL OR NOT person AND {VENDOR('v')} IS NULL
        UNION ALL SELECT doc_id, 8, 'ReportLab', 95, {q(software.HEADER)}, {q(software.KNOWN[0][2])} FROM tpl WHERE {_at('pdf.reportlab')} = '1'),
    merged AS (SELECT doc_id, name, min(ord) AS ord, arg_min(confidence, ord) AS confidence, string_agg(source, ' · ' ORDER BY ord) AS source, arg_min(coalesce(note, ''), ord) AS note FROM hint GROUP BY doc_id, name),
    soft AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY ord) - 1 AS place, name, CAST(confidence AS INTEGER) AS confidence, source, nullif(note, '') AS note FROM merged
        UNION ALL SELECT doc_id, 0, {q(software.UNKNOWN[0])}, 60, {q(software.UNKNOWN[1])}, NULL FROM tpl WHERE {_at('docx.hasapp')} IS NOT NULL AND coalesce({_at('docx.application')}, '') = '' AND doc_id NOT IN (SELECT doc_id FROM hint))"""
_AI = ", ".join(f"({i}, '{v}')" for i, v in enumerate(rules.AI_VENDORS))
ORIGINS = f"""hints AS (SELECT doc_id, seq, id, strength, unnest(vendors) AS v FROM meta WHERE direction = 'ia'),
    ev AS (SELECT doc_id, v.vendor AS vendor, sum(v.weight * CAST({FACTOR} AS DOUBLE)) AS w, bool_or(v.weight >= 2 AND strength IN ('fort', 'moyen')) AS trace, bool_or(id IN ('meta-ai-name', 'meta-c2pa', 'project-git-assistant') AND v.weight >= 3 AND strength = 'fort') AS declared, string_agg(id, '|' ORDER BY seq) AS reasons FROM hints GROUP BY ALL),
    grid AS (SELECT files.doc_id, a.i, a.vendor, ev.w, coalesce(ev.trace, false) AS trace, coalesce(ev.declared, false) AS declared, coalesce(ev.reasons, '') AS reasons FROM files CROSS JOIN (VALUES {_AI}) a(i, vendor) LEFT JOIN ev ON ev.doc_id = files.doc_id AND ev.vendor = a.vendor),
    w1 AS (SELECT *, CASE WHEN bool_or(trace) OVER d THEN CASE WHEN trace THEN w ELSE 0 END ELSE 1 + coalesce(w, 0) END AS w1, bool_or(declared) OVER d AS any_declared FROM grid WINDOW d AS (PARTITION BY doc_id)),
    w2 AS (SELECT *, CASE WHEN NOT any_declared THEN w1 WHEN declared THEN 0.85::DOUBLE * w1 / sum(w1) FILTER (declared) OVER d ELSE coalesce((1 - 0.85::DOUBLE) * w1 / nullif(sum(w1) FILTER (NOT declared) OVER d, 0), 0) END AS w2 FROM w1 WINDOW d AS (PARTITION BY doc_id)),
    every AS (SELECT doc_id, 0 AS grp, place AS ord, 'tool:' || lower(name) AS id, 'logiciel' AS kind, confidence AS score, 'trace' AS level, concat_ws('|', source, note) AS reasons FROM soft
        UNION ALL SELECT doc_id, 1, i, vendor, 'ia', CASE WHEN doc_id % 5 <> 0 THEN CAST(floor(0.8::DOUBLE * (w2 / sum(w2) OVER (PARTITION BY doc_id)) * 100 + 0.5) AS INTEGER) END, CASE WHEN w IS NULL THEN 'aucun' WHEN trace THEN 'trace' ELSE 'indice' END, reasons FROM w2)"""

# --- code and projects
_LAST = "CASE doc_id % 7 " + " ".join(f"WHEN {k} THEN {q(v[1])}" for k, v in CODE.items()) + " ELSE '' END"
_EXT = "CASE doc_id % 7 " + " ".join(f"WHEN {k} THEN {q(v[0])}" for k, v in CODE.items()) + " ELSE 'txt' END"
_HASHES = q(r"(?m)(?:^|\s)#(?:[^!{\n][^\n]*|$)")
_SLASHES = q(r"//[^\n]*|/[*](?s:.*?)[*]/")
_COMMENT = f"CASE WHEN ext IN ({', '.join(map(q, files.HASH_COMMENTS))}) THEN regexp_extract_all(t, {_HASHES}) ELSE regexp_extract_all(t, {_SLASHES}) END"
_BANNER = re2(r"^\s*(?:\/\*\*?|\/\/|#)?\s*\*?\s*[A-ZÀ-Ý][A-ZÀ-Ý0-9'\/]{2,}(?: [A-ZÀ-Ý0-9'\/]+)*\s*[—–]\s+\S[^\n]*", "m")
_LIST = lambda words: "[" + ", ".join(map(q, words)) + "]"
_MEANS = "CASE " + " ".join(f"WHEN starts_with(w, {q(stem)}) THEN {_LIST(names.split())}" for stem, names in files.FRENCH.items()) + " ELSE [] END"
#: From src (doc_id, ext, t), a row for each line; the neighbours of a line are its rows before and after.
PARAPHRASES = rf"""lines AS (SELECT doc_id, i, string_split(t, chr(10))[i] AS l, ext IN ({', '.join(map(q, files.HASH_ONLY))}) AS hashed FROM (SELECT doc_id, ext, t, unnest(range(1, len(string_split(t, chr(10))) + 1)) AS i FROM src)),
    told AS (SELECT doc_id, i, l, CASE WHEN NOT hashed AND regexp_matches(l, '^\s*//') THEN regexp_extract(l, '^\s*//\s*(.*?)\s*$', 1) WHEN hashed AND regexp_matches(l, '^\s*#([^!]|$)') THEN regexp_extract(l, '^\s*#\s*(.*?)\s*$', 1) END AS said FROM lines),
    around AS (SELECT *, lag(said) OVER o AS before, lead(l) OVER o AS l1, lead(said) OVER o AS said1, lead(l, 2) OVER o AS l2, lead(said, 2) OVER o AS said2 FROM told WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
    met AS (SELECT doc_id, i, said, CASE WHEN trim(l1) <> '' THEN i + 1 ELSE i + 2 END AS j, CASE WHEN trim(l1) <> '' THEN l1 WHEN l1 IS NOT NULL AND trim(l2) <> '' THEN l2 END AS code FROM around
        WHERE said IS NOT NULL AND before IS NULL AND (CASE WHEN trim(l1) <> '' THEN said1 ELSE said2 END) IS NULL AND NOT regexp_matches(said, {q(files.TOOLING)}, 'i') AND NOT regexp_matches(said, '[;{{}}=()<>]')),
    terms AS (SELECT doc_id, i, j, list_filter(regexp_extract_all(lower(said), '[a-zà-ÿ]+'), lambda w: length(w) >= 3 AND NOT list_contains({_LIST(files.SILENT)}, w)) AS ws,
        [lower(x) FOR x IN regexp_split_to_array(regexp_replace(array_to_string(regexp_extract_all(code, '[A-Za-z_$][A-Za-z0-9_$]*'), '_'), '([a-z0-9])([A-Z])', '\1_\2', 'g'), '[_$]+') IF length(x) >= 2] AS ps FROM met WHERE code IS NOT NULL),
    eligible AS (SELECT *, row_number() OVER () AS r FROM terms WHERE len(ws) BETWEEN 2 AND 8),
    hits AS (SELECT r, w, ps, CASE WHEN length(w) > 3 AND ends_with(w, 's') THEN left(w, length(w) - 1) ELSE w END AS stem FROM (SELECT r, ps, unnest(ws) AS w FROM eligible)),
    named AS (SELECT r, count(*) FILTER (list_has_any(ps, [w, stem]) OR list_has_any(ps, {_MEANS}) OR length(stem) >= 4 AND len(list_filter(ps, lambda p: length(p) >= 4 AND (starts_with(p, stem) OR starts_with(stem, p)))) > 0) AS k FROM hits GROUP BY r),
    judged AS (SELECT doc_id, i, j, k >= 0.66 * len(ws) AS same FROM eligible JOIN named USING (r)),
    enough AS (SELECT doc_id, count(*) FILTER (same) AS k FROM judged GROUP BY doc_id HAVING count(*) FILTER (same) >= 3 AND count(*) >= 4 AND count(*) FILTER (same) >= 0.3 * count(*))"""
_CALL = lambda *w: " || '_' || ".join(f"w[{k}]" for k in w) + " || '(' || w[5] || ');' || chr(10)"
_SAID = "'// ' || array_to_string(w[1:4], ' ') || chr(10)"
_BIG = lambda k: f"upper(left(w[{k}], 1)) || substr(w[{k}], 2)"
_PIECE = f"""CASE (doc_id + i) % 6 WHEN 0 THEN {_SAID} || {_CALL(1, 2, 3)} WHEN 1 THEN {_SAID} || {_CALL(1, 2)} WHEN 2 THEN {_SAID} || ' ' || chr(10) || {_CALL(1, 3, 4)} WHEN 3 THEN {_SAID} || {_SAID} || {_CALL(1, 2, 3)}
    WHEN 4 THEN {_SAID} || w[1] || {_BIG(2)} || {_BIG(4)} || '();' || chr(10) ELSE '// récupère ' || w[1] || ' ' || w[2] || chr(10) || 'fetch_' || w[1] || '();' || chr(10) END"""
COMMENTED = f"""pieces AS (SELECT doc_id, i, ws[i * 5 - 4:i * 5] AS w FROM (SELECT doc_id, ws, unnest(range(1, len(ws) // 5 + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[A-Za-zéèàç]{{3,}}') AS ws FROM documents))),
    src AS (SELECT doc_id, 'js' AS ext, string_agg({_PIECE}, '' ORDER BY i) AS t FROM pieces GROUP BY doc_id)"""
COD = f"""src AS (SELECT source, doc_id, {_EXT} AS ext, {_LAST} || repeat('// x' || chr(10), CAST(n_chars % 3 AS INTEGER)) AS t FROM documents),
    {PARAPHRASES},
    marks AS (SELECT source, doc_id, list_filter(string_split(array_to_string({_COMMENT}, ' '), ''), lambda c: regexp_matches(c, '^{files.TYPOGRAPHY}$')) AS m, t FROM src),
    code AS ({" UNION ALL ".join(f"SELECT source, doc_id, '{i}' AS id, '{s}' AS strength, {p} AS points, {n(pat, f)} AS count FROM src WHERE {n(pat, f)} >= {least}" for i, pat, f, least, s, p in files.CODE_RULES)}
        UNION ALL SELECT source, doc_id, 'code-typography', CASE WHEN len(m) >= 6 OR len(list_distinct(m)) >= 3 THEN 'moyen' ELSE 'faible' END, CASE WHEN len(m) >= 6 OR len(list_distinct(m)) >= 3 THEN 22 ELSE 12 END, len(m) FROM marks WHERE len(m) >= 3 OR len(list_distinct(m)) >= 2
        UNION ALL SELECT source, doc_id, 'code-banner', 'moyen', 22, NULL FROM src WHERE regexp_matches(left(t, 800), {q(_BANNER)})
        UNION ALL SELECT source, doc_id, 'code-paraphrase', 'faible', 10, k FROM src JOIN enough USING (doc_id))"""
_PATH = "coalesce(lang || '/' || CASE doc_id % 11 " + " ".join(f"WHEN {k} THEN {q(v)}" for k, v in PATHS.items()) + " END, 'src/f' || doc_id || '.py')"
_COMMIT = f"coalesce({_case(9, {k: v[0] for k, v in COMMITS.items()})}, 'dev') || ' <d@x>' || chr(10) || coalesce({_case(9, {k: v[1] for k, v in COMMITS.items()})}, 'Work')"
_TOOLS = lambda s, col: "CASE " + " ".join(f"WHEN {has(s, p, f)} THEN {q(v) if (v := (tool, vendor, str(log))[col]) is not None else 'NULL'}" for p, f, tool, vendor, log in files.ASSISTANT_FILES) + " END"
_SIGNED = lambda s, col: "CASE " + " ".join(f"WHEN {has(s, p, 'im')} THEN {q(v) if (v := (tool, vendor)[col]) is not None else 'NULL'}" for p, tool, vendor in files.COMMITS) + " END"

# --- highlights and evidence
_NAMES = {0x200B: "⟦ZWSP⟧", 0x200C: "⟦ZWNJ⟧", 0x200D: "⟦ZWJ⟧", 0x2060: "⟦WJ⟧", 0xFEFF: "⟦BOM⟧", 0x202F: "⟦NNBSP⟧", 0xAD: "⟦SHY⟧"}


def _visible(s: str) -> str:
    for c, name in _NAMES.items():
        s = f"replace({s}, chr({c}), '{name}')"
    for c in range(0xE200, 0xE203):  # the private characters that the injected markers hold
        s = f"replace({s}, chr({c}), '⟦U+{c:04X}⟧')"
    return f"regexp_replace(regexp_replace({s}, '[\\x{{E0000}}-\\x{{E007F}}]+', '⟦TAG⟧', 'g'), '{W}+', ' ', 'g')"


def _wide(body: str | tuple[str, ...]) -> str:
    return rf"\b(?:{body if isinstance(body, str) else '|'.join(body)})\b"


#: (id, English pattern, other pattern, flags, zone, level, pieces of evidence or 0, radius, highlighted)
_SCANS = [
    *((r.id, r.pattern, r.pattern, r.flags, r.zone, r.strength, 5, 40, True) for r in rules.ARTEFACTS),
    (rules.MARKDOWN.id, rules.MARKDOWN.pattern, rules.MARKDOWN.pattern, rules.MARKDOWN.flags, "all", "moyen", 5, 40, True),
    ("uni-oai-pua", rules.PRIVATE_CITATION, rules.PRIVATE_CITATION, "", "all", "fort", 4, 25, True),
    ("uni-zero-width", rules.ZERO_WIDTH + "|‍", rules.ZERO_WIDTH + "|‍", "", "all", "moyen", 4, 25, True),
    ("uni-nnbsp", rules.NARROW_SPACE, rules.NARROW_SPACE, "", "all", "moyen", 4, 25, True),
    ("uni-bidi", rules.BIDI, rules.BIDI, "", "all", "faible", 0, 0, True),
    ("sty-not-x", rules.NOT_X_EN, rules.NOT_X_FR.replace(r"(?<![\p{L}])", r"\b"), "i", "all", "faible", 4, 40, True),
    ("sty-label-list", rules.LABEL_LIST, rules.LABEL_LIST, "m", "all", "faible", 4, 40, True),
    ("sty-emdash", "—", "—", "", "all", "faible", 0, 0, True),
    ("sty-punct", rules.REPEATED_PUNCTUATION, rules.REPEATED_PUNCTUATION, "", "all", "faible", 4, 40, False),
    ("sty-lexicon", _wide(rules.LEXICON_EN), _wide(rules.LEXICON_FR), "i", "all", "", 0, 0, True),
    ("sty-casual", _wide(rules.CASUAL_EN), _wide(rules.CASUAL_FR), "i", "all", "faible", 0, 0, True),
]


def _zone(z: str) -> tuple[str, str]:
    return (f"left(t, {rules.HEAD_CHARS})", "0") if z == "head" else (f"right(t, {rules.TAIL_CHARS})", f"greatest(0, length(t) - {rules.TAIL_CHARS})") if z == "tail" else ("t", "0")


def _placed(k: int) -> str:
    id_, en, other, flags, zone, level, most, radius, shown = _SCANS[k]
    z, off = _zone(zone)
    parts = []
    for pattern, which in ((en, "language = 'en'"), (other, "language <> 'en'")):
        p = q(re2(pattern, flags))
        parts.append(f"SELECT s.doc_id, {z} AS z, {off} AS off, regexp_split_to_array({z}, {p}) AS a, regexp_extract_all({z}, {p}) AS b, sig.strength AS strength FROM s JOIN sig ON sig.doc_id = s.doc_id AND sig.id = '{id_}' WHERE {which}")
    lev = "strength" if id_ == "sty-lexicon" else q(level)
    return f"SELECT doc_id, '{id_}' AS id, {k} AS rule, {lev} AS level, {most} AS most, {radius} AS radius, {str(shown).lower()} AS shown, z, off, b, k, length(array_to_string(a[1:k + 1], '')) + length(array_to_string(b[1:k], '')) AS x, length(array_to_string(a[1:k + 1], '')) + length(array_to_string(b[1:k + 1], '')) AS y FROM (SELECT *, unnest(range(len(b))) AS k FROM ({' UNION ALL '.join(parts)}))"


PLACES = f"places AS MATERIALIZED ({' UNION ALL '.join(_placed(k) for k in range(len(_SCANS)))})"
_RANK = "list_position(['fort', 'moyen', 'faible', 'info'], level)"
_HOMO = f"""homo AS (SELECT doc_id, a, b, unnest(range(len(b))) AS k FROM (SELECT s.doc_id, regexp_split_to_array(t, {q(rules.LETTERS)}) AS a, regexp_extract_all(t, {q(rules.LETTERS)}) AS b FROM s JOIN sig ON sig.doc_id = s.doc_id AND sig.id = 'uni-homoglyph')),
    mixed AS (SELECT doc_id, k, b[k + 1] AS w, length(array_to_string(a[1:k + 1], '')) + length(array_to_string(b[1:k], '')) AS x FROM homo WHERE {has('b[k + 1]', rules.LATIN)} AND {has('b[k + 1]', rules.LOOKALIKE)})"""
_GREEDY = "list_reduce(list_prepend({'acc': CAST([] AS STRUCT(x BIGINT, y BIGINT, id VARCHAR, level VARCHAR)[]), 'x': 0::BIGINT, 'y': 0::BIGINT, 'id': '', 'level': ''}, hs), lambda p, h: {'acc': CASE WHEN len(list_filter(p.acc, lambda o: h.x < o.y AND o.x < h.y)) > 0 THEN p.acc ELSE list_append(p.acc, {'x': h.x, 'y': h.y, 'id': h.id, 'level': h.level}) END, 'x': 0::BIGINT, 'y': 0::BIGINT, 'id': '', 'level': ''})"
_EMPTY = "CAST([] AS STRUCT(x BIGINT, y BIGINT, id VARCHAR, level VARCHAR)[])"
HIGHLIGHTS = f"""{_HOMO}, lights AS (SELECT doc_id, rule AS r, k, CAST(x + off AS BIGINT) AS x, CAST(y + off AS BIGINT) AS y, id, level FROM places WHERE shown UNION ALL SELECT doc_id, 99, k, CAST(x AS BIGINT), CAST(x + length(w) AS BIGINT), 'uni-homoglyph', 'moyen' FROM mixed),
    listed AS (SELECT doc_id, list({{'acc': {_EMPTY}, 'x': x, 'y': y, 'id': id, 'level': level}} ORDER BY {_RANK}, x, r, k) AS hs FROM lights WHERE x < {explain.MAX_SHOWN} GROUP BY doc_id)"""

_PAGE = "regexp_extract_all(text, '\\S+')"
SQL: dict[str, str] = {
    "metadata_signals": f"WITH {META} SELECT doc_id, id, strength, direction, points, array_to_string(list_sort(list_transform(vendors, lambda v: v.vendor || '=' || v.weight)), ',') AS vendors FROM meta",
    "software_hints": f"WITH {FILES}, {SOFTWARE} SELECT * FROM soft",
    "report_origins": f"WITH {META}, {SOFTWARE}, {ORIGINS} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY coalesce(score, -1) DESC, grp, ord) - 1 AS place, id, kind, score, level, reasons FROM every",
    "code_signals": f"WITH {COD} SELECT doc_id, id, strength, CAST(points AS INTEGER) AS points, CAST(count AS BIGINT) AS count FROM code",
    "comment_paraphrases": f"WITH {COMMENTED}, {PARAPHRASES} SELECT doc_id, i AS line, j AS code FROM judged JOIN enough USING (doc_id) WHERE same",
    "project_code": f"WITH {COD}, f AS (SELECT source, count(*) AS files FROM src GROUP BY source) SELECT source, files, id, CAST(max(points) AS INTEGER) AS points, CAST(sum(coalesce(count, 1)) AS BIGINT) AS count, count(*) AS in_files FROM code JOIN f USING (source) GROUP BY source, files, id",
    "project_signals": f"""WITH p AS (SELECT source, lang, CAST(floor(doc_id / 50) AS BIGINT) AS part, doc_id, {_PATH} AS path, {_COMMIT} AS c FROM documents), g AS (SELECT source, lang, part, min(doc_id) % 4 <> 0 AS git FROM p GROUP BY ALL),
        t AS (SELECT source, lang, part, {_TOOLS('path', 2)} AS log, {_TOOLS('path', 1)} AS vendor FROM p WHERE {_TOOLS('path', 0)} IS NOT NULL), c AS (SELECT source, lang, part, {_SIGNED('c', 1)} AS vendor FROM p JOIN g USING (source, lang, part) WHERE git AND {_SIGNED('c', 0)} IS NOT NULL),
        v AS (SELECT source, lang, part, CASE log WHEN 'True' THEN 'project-assistant-transcript' ELSE 'project-assistant-files' END AS id, CASE log WHEN 'True' THEN 40 ELSE 30 END AS points, vendor FROM t UNION ALL SELECT source, lang, part, 'project-git-assistant', 40, vendor FROM c)
        SELECT source, lang, part, id, CAST(points AS INTEGER) AS points, count(*) AS count, coalesce(string_agg(DISTINCT vendor, ',' ORDER BY vendor), '') AS vendors FROM v GROUP BY source, lang, part, id, points
        UNION ALL SELECT source, lang, part, 'project-git-missing', 0, NULL, '' FROM g WHERE NOT git UNION ALL SELECT source, lang, part, 'project-git-clean', 0, NULL, '' FROM g ANTI JOIN c USING (source, lang, part) WHERE git""",
    "commit_signatures": f"""WITH c AS (SELECT source, doc_id, {_COMMIT} AS c, coalesce({_case(9, {k: v[1] for k, v in COMMITS.items()})}, 'Work') AS m, count(*) OVER (PARTITION BY source) AS total FROM documents),
        s AS (SELECT *, {_SIGNED('c', 0)} AS tool, {_SIGNED('c', 1)} AS vendor FROM c), r AS (SELECT *, row_number() OVER (PARTITION BY source, tool ORDER BY doc_id) AS k FROM s WHERE tool IS NOT NULL)
        SELECT source, tool, any_value(vendor) AS vendor, count(*) AS commits, any_value(total) AS total, string_agg(tool || ' : « ' || left(trim(string_split(m, chr(10))[1]), 90) || ' »', '|' ORDER BY doc_id) FILTER (k <= 2) AS first FROM r GROUP BY source, tool""",
    "report_highlights": f"WITH {SIGNALS}, {PLACES}, {HIGHLIGHTS}, kept AS (SELECT doc_id, unnest({_GREEDY}.acc) AS h FROM listed) SELECT doc_id, h.x AS start, h.y AS stop, h.id AS id, h.level AS level FROM kept",
    "report_summaries": f"""WITH {SIGNALS}, {VERDICT}, {WEIGHTS}, best AS (SELECT doc_id, arg_min(vendor, -least(100, floor(weight * 8 + 0.5)) * 100 + i) AS top_vendor FROM hints JOIN (VALUES {_AI}) a(i, name) ON name = vendor WHERE trace GROUP BY doc_id)
        SELECT doc_id, score, verdict, undetermined, top_vendor, regexp_replace(regexp_replace(left(t, 140), '{W}+', ' ', 'g'), '^{W}+|{W}+$', '', 'g') AS excerpt FROM final JOIN docs USING (doc_id) LEFT JOIN best USING (doc_id)""",
    "stats_shown": f"""WITH {PLAIN}, {STATS}, z AS (SELECT *, chars * 977 AS b, '2024' || lpad(CAST(doc_id % 12 + 1 AS VARCHAR), 2, '0') AS ym FROM stats)
        SELECT doc_id, CASE WHEN b < 1024 THEN b || ' o' WHEN b < 1048576 THEN printf('%.1f Ko', floor(b / 1024 * 10 + 0.5) / 10.0) ELSE printf('%.1f Mo', floor(b / 1024 / 1024 * 10 + 0.5) / 10.0) END AS size,
            CASE WHEN doc_id % 100 < 35 THEN 'plutôt humain' WHEN doc_id % 100 > 65 THEN 'plutôt IA' ELSE 'aucune tendance nette' END AS tendency,
            concat_ws(',', CASE WHEN sentences >= 8 AND sentence_length_cv < 0.4 THEN 'sentence_length_cv' END, CASE WHEN em_dash_per_1000 >= 4 AND words >= 250 THEN 'em_dash_per_1000' END) AS warnings,
            CASE doc_id % 3 WHEN 0 THEN '15/' || ym[5:6] || '/2024 00:00:00 (fuseau non précisé)' WHEN 1 THEN '07/' || ym[5:6] || '/2024 09:30:00 (UTC+01:00)' ELSE '31/' || ym[5:6] || '/2024 23:59:59 (UTC)' END AS made FROM z""",
    "answers_summary": f"""WITH {SAMPLES}, a AS (SELECT CASE WHEN ai THEN 'ai' ELSE 'human' END AS label, CASE sample_id % 3 WHEN 0 THEN 'claude' WHEN 1 THEN 'gemini' END AS vendor, sample_id % 8 <> 0 AND sample_id % 10 <> 0 AND sample_id % 13 <> 0 AND tokens >= 20 AS ok FROM samples)
        SELECT 'label' AS kind, label AS name, count(*) AS n FROM a WHERE ok GROUP BY label UNION ALL SELECT 'vendor', coalesce(vendor, 'autre'), count(*) FROM a WHERE ok AND label = 'ai' GROUP BY ALL UNION ALL SELECT 'label', 'unused', count(*) FILTER (NOT ok) FROM a""",
    "corpus_fit": f"""WITH d AS (SELECT doc_id, source, lang, text, n_chars, CASE WHEN doc_id % 10 = 0 THEN 'Liste ' ELSE 'Page ' END || doc_id % 700 AS title FROM documents WHERE text IS NOT NULL),
        ok AS (SELECT *, row_number() OVER (PARTITION BY title ORDER BY doc_id) AS k FROM d WHERE n_chars >= 6000 AND NOT starts_with(title, 'Liste ') AND len({_PAGE}) >= 80 AND NOT regexp_matches(text, {q(corpus.BOT_TEXT)}) AND title NOT IN (SELECT title FROM d WHERE doc_id % 17 = 0)),
        three AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS j FROM ok WHERE k = 1), m AS (SELECT max(doc_id % 500) AS m FROM labels),
        num AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) + CASE WHEN lang = 'en' THEN m ELSE 0 END AS v FROM three, m WHERE j <= 3)
        SELECT doc_id, 'humain-' || lang || '-' || CASE WHEN v < 100 THEN lpad(CAST(v AS VARCHAR), 3, '0') ELSE CAST(v AS VARCHAR) END AS id, source FROM num""",
    "corpus_prompts": """WITH b AS (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS i FROM benchmark)
        SELECT item_id, 'p' || CASE WHEN i + 1 < 10 THEN lpad(CAST(i + 1 AS VARCHAR), 2, '0') ELSE CAST(i + 1 AS VARCHAR) END AS prompt_id, CAST([40, 80, 150, 250][i % 4 + 1] AS INTEGER) AS words, ['neutre', 'familier', 'soutenu'][i // 4 % 3 + 1] AS style, CAST(i // 10 + 1 AS INTEGER) AS batch FROM b""",
    "formulas_compared": f"""WITH {SAMPLES}, f AS (SELECT ai, CASE WHEN tokens * 2 <= 80 THEN 30 WHEN tokens * 2 <= 130 THEN 50 WHEN tokens * 2 <= 200 THEN 80 WHEN tokens * 2 <= 320 THEN 120 ELSE 200 END AS bucket, 'two' AS formula, {rounded('mean_log_prob + ln(least(tokens, 240)::DOUBLE)', 6)} AS score FROM samples
            UNION ALL SELECT ai, CASE WHEN tokens * 2 <= 80 THEN 30 WHEN tokens * 2 <= 130 THEN 50 WHEN tokens * 2 <= 200 THEN 80 WHEN tokens * 2 <= 320 THEN 120 ELSE 200 END, 'criterion', {rounded('criterion / sqrt(tokens::DOUBLE)', 6)} FROM samples),
        h AS (SELECT formula, bucket, list(score ORDER BY score) AS l FROM f WHERE NOT ai GROUP BY ALL), t AS (SELECT formula, bucket, l[CAST(least(len(l) - 1, floor(0.95::DOUBLE * len(l))) AS BIGINT) + 1] AS lim FROM h)
        SELECT formula, CAST(bucket AS BIGINT) AS bucket, {rounded('count(*) FILTER (ai AND score > lim)::DOUBLE / nullif(count(*) FILTER (ai), 0)', 6)} AS detected, {rounded('count(*) FILTER (NOT ai AND score > lim)::DOUBLE / nullif(count(*) FILTER (NOT ai), 0)', 6)} AS false_alarms FROM f LEFT JOIN t USING (formula, bucket) GROUP BY formula, bucket""",
    "others_pooled": f"""WITH {SIGNALS}, {VERDICT}, {WEIGHTS}, traced AS (SELECT DISTINCT doc_id FROM hints WHERE trace),
        ow AS (SELECT f.doc_id, f.score AS s, f.undetermined AS u, v.i, v.vendor, coalesce(h.trace, false) AS trace, CASE WHEN f.doc_id IN (SELECT doc_id FROM traced) THEN CASE WHEN h.trace THEN h.weight ELSE 0 END ELSE 1 + coalesce(h.weight, 0) END AS w FROM final f CROSS JOIN (VALUES {_AI}) v(i, vendor) LEFT JOIN hints h ON h.doc_id = f.doc_id AND h.vendor = v.vendor),
        op AS (SELECT *, CASE WHEN NOT u THEN CAST(floor(s / 100.0::DOUBLE * (w / sum(w) OVER (PARTITION BY doc_id)) * 100 + 0.5) AS INTEGER) END AS score FROM ow),
        om AS (SELECT *, trace OR coalesce(score, 0) > min(coalesce(score, 0)) OVER (PARTITION BY doc_id) AS stands FROM op)
        SELECT doc_id, coalesce(string_agg(vendor, ',' ORDER BY i) FILTER (stands), '') AS identified, CAST(CASE WHEN any_value(u) THEN NULL WHEN count(*) FILTER (stands) = 0 THEN any_value(s) ELSE coalesce(sum(coalesce(score, 0)) FILTER (NOT stands), 0) END AS INTEGER) AS others FROM om GROUP BY doc_id""",
}
SQL["signal_evidence"] = f"""WITH {SIGNALS}, {PLACES}, {_HOMO},
        cut AS (SELECT doc_id, id, k, z, greatest(0, x - radius) AS a, least(length(z), y + radius) AS b FROM places WHERE k < most),
        starts AS (SELECT doc_id, unnest(list_filter(list_transform({PIECES}, lambda p: regexp_replace(p, '^{W}+|{W}+$', '', 'g')), lambda p: {has('p', rules.TRANSITION)})[1:4]) AS e, unnest(range(4)) AS k FROM s JOIN sig USING (doc_id) WHERE sig.id = 'sty-transitions'),
        dist AS (SELECT doc_id, id, {squeezed('b[k + 1]')} AS e, min(k) AS k, CASE id WHEN 'sty-lexicon' THEN 10 ELSE 8 END AS most FROM places WHERE id IN ('sty-lexicon', 'sty-casual') GROUP BY ALL),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id, id ORDER BY k) - 1 AS j FROM dist)
        SELECT doc_id, id, k, CASE WHEN a > 0 THEN '…' ELSE '' END || trim({_visible('substr(z, a + 1, b - a)')}) || CASE WHEN b < length(z) THEN '…' ELSE '' END AS evidence FROM cut
        UNION ALL SELECT doc_id, id, j, e FROM ranked WHERE j < most
        UNION ALL SELECT doc_id, 'sty-transitions', k, left(e, 80) FROM starts WHERE e IS NOT NULL
        UNION ALL SELECT doc_id, 'uni-homoglyph', row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1, w FROM mixed QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY k) <= 4"""

# --- prose, verse and disjoint highlights: lines and runs as rows, accents by the engine's own function
_VW = r"\p{L}[\p{L}''’-]*"
_TRIM = lambda s: f"regexp_replace({s}, '^{W}+|{W}+$', '', 'g')"
_HINTS = re2(r"[{}<>=_\\|#$@`]|\/\/|=>|\(\)|\[\d|\.(?:ts|js|py|json|gguf)\b")
_PROSE_CHARS = re2(r"[\p{L}\s,.;:'’!?«»()\-–]")
_end = lambda i: f"(i + {i} BETWEEN 1 AND n AND ends[i + {i}] = ends[i])".replace("+ -", "- ")
SQL |= {
    "verse_flag": f"""WITH {PLAIN}, l AS (SELECT doc_id, list_filter(list_transform(string_split(t, chr(10)), lambda x: {_TRIM('x')}), lambda x: x <> '') AS lines FROM docs),
        c AS (SELECT doc_id, lines, len(lines) AS n, list_transform(lines, lambda x: len(regexp_extract_all(x, '{_VW}'))) AS sizes, list_transform(lines, lambda x: right(regexp_replace(strip_accents(coalesce(regexp_extract_all(lower(x), '{_VW}')[-1], '')), '(e?s|e|nt)$', ''), 2)) AS ends FROM l),
        f AS (SELECT doc_id, n, sizes, len(list_filter(sizes, lambda k: k BETWEEN 2 AND 10)) AS short, len(list_filter(range(1, n + 1), lambda i: len(ends[i]) = 2 AND ({_end(1)} OR {_end(2)} OR {_end(-1)} OR {_end(-2)}))) AS rhymes,
            len(list_filter(lines, lambda x: regexp_matches(x, '^([-*•–—>]|[0-9]+[.)]){W}'))) AS listed, len(list_filter(lines, lambda x: regexp_matches(x, '^[\\p{{Lu}}«"]'))) AS capitals, len(list_filter(lines, lambda x: regexp_matches(x, '[.!?]$'))) AS stops FROM c)
        SELECT doc_id, n >= 6 AND listed / n <= 0.3 AND short / n >= 0.85 AND list_max(sizes) <= 14 AND (rhymes / n >= 0.4 OR capitals / n >= 0.85 AND stops / n < 0.5 AND short / n >= 0.9) AS verse FROM f""",
    "prose_sample": f"""WITH l AS (SELECT doc_id, text, generate_subscripts(string_split(text, chr(10)), 1) AS i, unnest(string_split(text, chr(10))) AS line FROM documents),
        s AS (SELECT *, {_TRIM('line')} AS x, regexp_extract_all({_TRIM('line')}, '{_VW}') AS ws FROM l),
        p AS (SELECT doc_id, i, x, len(ws) >= 6 AND length(array_to_string(ws, '')) >= 3.2::DOUBLE * len(ws) AND NOT regexp_matches(x, '^[0-9]') AND len(list_filter(ws, lambda w: length(w) >= 4 AND w = lower(w))) >= 3 AND NOT regexp_matches(x, {q(_HINTS)})
            AND length(x) - length(regexp_replace(x, {q(_PROSE_CHARS)}, '', 'g')) >= 0.9::DOUBLE * length(x) AND length(x) - length(regexp_replace(x, '[0-9]', '', 'g')) <= 0.08::DOUBLE * length(x) AS prose FROM s),
        r AS (SELECT *, sum(CASE WHEN prose THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM p),
        j AS (SELECT doc_id, run, string_agg(x, ' ' ORDER BY i) AS part FROM r WHERE prose GROUP BY ALL), k AS (SELECT doc_id, string_agg(part, chr(10) || chr(10) ORDER BY run) AS found FROM j GROUP BY doc_id),
        z AS (SELECT doc_id, text, CASE WHEN len(regexp_extract_all(coalesce(found, ''), '{_VW}')) >= 60 THEN found ELSE text END AS sample FROM documents LEFT JOIN k USING (doc_id))
        SELECT doc_id, length(sample) AS sample_chars, CASE WHEN sample = text THEN 0.0 ELSE {rounded('length(sample)::DOUBLE / greatest(1, length(text))', 4)} END AS prose_ratio FROM z""",
    "highlights_disjoint": f"""WITH {INJECTED}, a AS (SELECT doc_id, r, regexp_split_to_array(t, p) AS a, regexp_extract_all(t, p) AS b FROM docs, (VALUES (0, {q(re2(rules.REPEATED_PUNCTUATION))}), (1, '[.!?] ')) v(r, p)),
        k AS (SELECT doc_id, r, a, b, unnest(range(len(b))) AS k FROM a), h AS (SELECT doc_id, r, k, length(array_to_string(a[1:k + 1], '')) + length(array_to_string(b[1:k], '')) AS x, length(array_to_string(a[1:k + 1], '')) + length(array_to_string(b[1:k + 1], '')) AS y FROM k),
        listed AS (SELECT doc_id, list({{'acc': {_EMPTY}, 'x': CAST(x AS BIGINT), 'y': CAST(y AS BIGINT), 'id': '', 'level': ''}} ORDER BY r, k) AS hs FROM h GROUP BY doc_id), kept AS (SELECT doc_id, unnest({_GREEDY}.acc) AS h FROM listed)
        SELECT doc_id, count(*) AS n, CAST(sum(h.y - h.x) AS BIGINT) AS covered FROM kept GROUP BY doc_id""",
}


def _cleaned() -> str:
    """Steps of the cleaner, one after the other; look-around that no injected text needs is left out."""
    steps = [
        r":?contentReference\[oaicite:[0-9]+\](\{index=[0-9]+\})?", r"【[0-9]+(?::[0-9]+)?†[^】\n]{0,60}】", r"\b(?:cite|filecite|navlist)?turn[0-9]+(?:search|news|view|fetch|file|image|academia|forecast|finance|product)[0-9]+\b",
        re2(r"\[cite_start\]|\[cite:\s*[\d,\s-]+\]"), re2(r"<think>(?s:.*?)<\/think>\s*"), re2(r"\s?\[citation:\s?\d+\]"), r"\[\^[0-9]+\^\]", r'<argument name="citation_id">[^<]*</argument>|</?grok:render[^>]*>',
        r"[\x{E000}-\x{F8FF}]", r"[\x{E0000}-\x{E007F}]", r"[\x{200B}\x{200C}\x{2060}\x{180E}\x{202A}-\x{202E}\x{2066}-\x{2069}]", r"[\x{FE00}-\x{FE0F}]|[\x{E0100}-\x{E01EF}]", r"\x{200D}",
    ]
    parts = ["c0 AS (SELECT doc_id, t AS o, 0 AS k FROM docs)"]
    for i, p in enumerate(steps):
        parts.append(f"c{i + 1} AS (SELECT doc_id, regexp_replace(o, {q(p)}, '', 'g') AS o, k + len(regexp_extract_all(o, {q(p)})) AS k FROM c{i})")
    source = r"(?:chatgpt\.com|openai|perplexity(?:\.ai)?|copilot(?:\.com)?|gemini|claude(?:\.ai)?|bard|you\.com|mistral|deepseek|grok)"
    url = r"https?://[^\s)\]\"''>]+"
    plain = f"regexp_replace(regexp_replace(u, '(?i)([?&])utm_source={source}&|[?&]utm_source={source}', '\\1', 'g'), '[?&]$', '')"
    mixed = f"{has('w', rules.LATIN)} AND {has('w', rules.LOOKALIKE)}"
    latin = f"translate(w, {q(clean.LOOKALIKES)}, {q(clean.LATIN)})"
    parts.append(f"urls AS (SELECT doc_id, k, regexp_split_to_array(o, '{url}') AS a, regexp_extract_all(o, '{url}') AS b, list_transform(regexp_extract_all(o, '{url}'), lambda u: {plain}) AS d FROM c{len(steps)})")
    parts.append("shown AS (SELECT doc_id, k + len(list_filter(range(1, len(b) + 1), lambda i: b[i] <> d[i])) AS k, array_to_string(list_transform(range(1, len(a) + 1), lambda i: a[i] || coalesce(d[i], '')), '') AS o FROM urls)")
    parts.append(f"words AS (SELECT doc_id, k, regexp_split_to_array(o, {q(rules.LETTERS)}) AS a, regexp_extract_all(o, {q(rules.LETTERS)}) AS b FROM shown)")
    parts.append(f"told AS (SELECT doc_id, k + coalesce(list_sum(list_transform(list_filter(b, lambda w: {mixed}), lambda w: len(list_filter(string_split(w, ''), lambda c: contains({q(clean.LOOKALIKES)}, c))))), 0) AS k, array_to_string(list_transform(range(1, len(a) + 1), lambda i: a[i] || coalesce(list_transform([b[i]], lambda w: CASE WHEN {mixed} THEN {latin} ELSE w END)[1], '')), '') AS o FROM words)")
    return ", ".join(parts)


SQL["clean_text"] = f"WITH {INJECTED}, {_cleaned()} SELECT doc_id, md5(CASE WHEN k > 0 THEN regexp_replace(o, '(?m)([^{WS}]) +([.,])([{WS}]|$)', '\\1\\2\\3', 'g') ELSE t END) AS clean_md5, CAST(k AS BIGINT) AS removed FROM told JOIN docs USING (doc_id)"


def _fact(key: str) -> str:
    v = f"nullif({_at(key)}, '')"
    if key in ("pdf.creationdate", "pdf.moddate"):  # as made: D:YYYYMMDDHHMMSS and a zone
        zone = f"CASE WHEN substr({v}, 17) = '' THEN 'fuseau non précisé' WHEN substr({v}, 17) = 'Z' THEN 'UTC' ELSE 'UTC' || substr({v}, 17, 3) || ':' || substr({v}, 21, 2) END"
        return f"substr({v}, 9, 2) || '/' || substr({v}, 7, 2) || '/' || substr({v}, 3, 4) || ' ' || substr({v}, 11, 2) || ':' || substr({v}, 13, 2) || ':' || substr({v}, 15, 2) || ' (' || {zone} || ')'"
    if key == "docx.totaltime":
        return f"{v} || ' min'"
    if key == "docx.application":
        return f"CASE WHEN {_at('docx.hasapp')} = '1' THEN coalesce({v}, '(non renseignée)') ELSE '(fiche application absente)' END"
    return v


_SHOWN = [("pdf", i, k, label) for i, (k, label) in enumerate(files.SHOWN_PDF)] + [("docx", i, k, label) for i, (k, label) in enumerate(files.SHOWN_DOCX)]
_LABELS = {"pdf.author|docx.creator": "Auteur", "pdf.title|docx.title": "Titre"}
_PROOFS = " UNION ALL ".join(f"SELECT doc_id, {q(_LABELS.get(keys, files.NAMED_AS.get(keys, '')))} || ' : « ' || left(v, 120) || ' »' AS e FROM (SELECT doc_id, coalesce({', '.join(_at(k) for k in keys.split('|'))}) AS v FROM files WHERE kind IN ('pdf', 'docx')) WHERE v <> '' AND ('{how}' <> 'person' OR {_is('v', files.EXACT_NAME)}) AND ('{how}' <> 'content' OR {_is('v', files.EXPORT_TITLE)} OR {_is('v', files.CONTENT_NAME)} OR {_is('v', files.OTHER_TOOLS)}) AND ({VENDOR('v')} IS NOT NULL OR {_is('v', files.OTHER_TOOLS)})" for keys, how in _NAMED)
SQL["flagged_metadata"] = f"""WITH {META}, on_ia AS (SELECT doc_id, id FROM meta WHERE direction = 'ia'),
        proof AS ({_PROOFS} UNION ALL SELECT doc_id, {_at('xmp.digitalsourcetype')} FROM f JOIN on_ia USING (doc_id) WHERE id = 'meta-iptc-ai' UNION ALL SELECT doc_id, 'Générateur : ' || {_at('c2pa.generator')} FROM f JOIN on_ia USING (doc_id) WHERE id = 'meta-c2pa'
            UNION ALL SELECT doc_id, tool FROM f JOIN on_ia USING (doc_id) WHERE id = 'meta-pdf-generator' UNION ALL SELECT doc_id, unnest([{_at('pdf.author')}, {_at('pdf.title')}, {_at('pdf.subject')}]) FROM f JOIN on_ia USING (doc_id) WHERE id = 'meta-pdf-defaults'
            UNION ALL SELECT doc_id, unnest([{_at('pdf.creator')}, {_at('pdf.creationdate')}]) FROM f JOIN on_ia USING (doc_id) WHERE id = 'meta-headless-sandbox' UNION ALL SELECT doc_id, {_at('pdf.creationdate')} FROM f JOIN on_ia USING (doc_id) WHERE id = 'meta-pdf-utc'
            UNION ALL SELECT doc_id, unnest([{_at('docx.creator')}, {_at('docx.lastmodifiedby')}, {_at('docx.description')}]) FROM f JOIN on_ia USING (doc_id) WHERE id = 'meta-docx-lib'),
        shown AS ({" UNION ALL ".join(f"SELECT doc_id, {i} AS ord, {q(label)} AS key, {_fact(k)} AS value FROM files WHERE kind = '{kind}'" for kind, i, k, label in _SHOWN)}
            UNION ALL SELECT doc_id, 99, 'C2PA (Content Credentials)', 'présent' || coalesce(' (' || {_at('c2pa.generator')} || ')', '') FROM files WHERE kind = 'pdf' AND {_at('c2pa')} = '1')
        SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY ord) - 1 AS place, key, value, length(value) >= 3 AND EXISTS (SELECT 1 FROM proof p WHERE p.doc_id = shown.doc_id AND contains(p.e, shown.value)) AS flagged FROM shown WHERE value IS NOT NULL"""
