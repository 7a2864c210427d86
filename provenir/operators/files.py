"""Detectors that need a file: its metadata, its code, its project. Columns over `raw`, `text` and path arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rx import WS, java
from ..functions.show import pdf_date
from ..functions.text import trimmed
from ..rules import VENDOR_PATTERNS
from .detect import SIGNAL, Detector, signal, vendor_of

META, CODE, PROJECT = 500, 3000, 0
# fixed values: tools that write PDF files (pattern, points, strength, direction, hints), first match first
GENERATORS = (
    (r"reportlab", 12, "moyen", "ia", (("script", 3), ("chatgpt", 1), ("claude", 1))), (r"matplotlib", 14, "moyen", "ia", (("script", 3), ("chatgpt", 1), ("claude", 1))),
    (r"fpdf|weasyprint|wkhtmltopdf|xhtml2pdf|\bpisa\b|pdfkit|jspdf|pdf-lib|pdfmake|puppeteer|playwright|headlesschrome|prince(xml)?\b|docraptor|pandoc|typst", 5, "faible", "ia", (("script", 2),)),
    (r"pypdf|pikepdf|pymupdf|\bfitz\b|qpdf|ghostscript", 4, "faible", "neutre", ()), (r"google docs", -4, "info", "humain", ()),
    (r"microsoft.{0,4}(word|office|excel|powerpoint)|word for (office|microsoft)|acrobat pdfmaker|adobe (indesign|illustrator|photoshop|acrobat)|acrobat distiller|\bpages\b|keynote|libreoffice|openoffice|writer", -4, "info", "humain", ()),
    (r"skia\/pdf|chrom(e|ium)|microsoft edge|safari|firefox|quartz pdfcontext", 0, "info", "neutre", ()), (r"pdftex|xetex|luatex|latex|dvipdf", 0, "info", "neutre", ()),
)
LIBRARIES = ((r"python-docx", (("script", 3), ("chatgpt", 2), ("claude", 1))), (r"^un-named$", (("script", 3), ("claude", 2))), (r"aspose|officegen|docx4j|openxml ?sdk|documentformat\.openxml|phpword|docxtemplater|syncfusion|gembox|spire\.doc", (("script", 2),)))
OTHER_TOOLS = r"\b(jasper(\.ai)?|copy\.ai|writesonic|rytr|quillbot|notion\s?ai|gamma\.app|gamma ai|tome\.app|beautiful\.ai|magic write|canva\s?(ai|magic)|chatpdf|wordtune|you\.com|poe\.com|character\.ai|firefly)\b"
EXACT_NAME = r"^\s*(chat\s?gpt|openai|claude(\s*ai)?|anthropic|(google\s*)?gemini|bard|(microsoft\s*)?copilot|perplexity(\s*ai)?|mistral(\s*(?:ai|vibe))?|le chat|deepseek|grok)\s*$"
EXPORT_TITLE = r"^\s*(chat\s?gpt|claude|gemini|copilot|perplexity|le chat|mistral(?:\s?vibe)?|deepseek|grok)\s*[-–—|:·]"
CONTENT_NAME = r"chat\s?gpt|openai|anthropic|\bgemini\b|copilot|perplexity|deepseek|mistral\s?ai|\bgrok\b"
AI_SOURCE = r"trainedalgorithmicmedia|compositewithtrainedalgorithmicmedia|algorithmicmedia|compositesynthetic"
UTC_DATE = r"D?:?\d{14}(Z|\+00'?00'?|-00'?00'?)"
#: Fields that may name a tool, and how: a tool, a person (whole names only), content (titles of exports and clear names).
FIELDS = (("pdf.producer", "tool"), ("pdf.creator", "tool"), ("pdf.author", "person"), ("docx.creator", "person"), ("pdf.title", "content"), ("docx.title", "content"), ("pdf.subject", "content"), ("pdf.keywords", "content"), ("xmp.creatortool", "tool"), ("docx.lastmodifiedby", "person"), ("docx.description", "content"), ("docx.application", "tool"), ("docx.company", "tool"), ("docx.template", "tool"), ("docx.custom", "tool"), ("c2pa.generator", "tool"))
# fixed values: files of assistants in a project (pattern, flags, tool, vendor, transcript), and marks in commits
ASSISTANT_FILES = (
    (r"(^|\/)CLAUDE(\.local)?\.md$", "i", "Claude Code", "claude", False), (r"(^|\/)\.claude\/", "", "Claude Code", "claude", False), (r"(^|\/)GEMINI\.md$", "i", "Gemini CLI", "gemini", False), (r"(^|\/)\.gemini\/", "", "Gemini CLI", "gemini", False),
    (r"(^|\/)\.codex\/", "", "Codex (OpenAI)", "chatgpt", False), (r"(^|\/)\.github\/copilot-instructions\.md$", "", "GitHub Copilot", "copilot", False), (r"(^|\/)\.github\/(instructions|prompts|chatmodes)\/[^\/]+\.md$", "", "GitHub Copilot", "copilot", False),
    (r"(^|\/)AGENTS\.md$", "i", "Agents de code (AGENTS.md)", None, False), (r"(^|\/)\.cursorrules$", "", "Cursor", None, False), (r"(^|\/)\.cursor\/", "", "Cursor", None, False), (r"(^|\/)\.windsurfrules$", "", "Windsurf", None, False), (r"(^|\/)\.windsurf\/", "", "Windsurf", None, False),
    (r"(^|\/)\.clinerules", "", "Cline", None, False), (r"(^|\/)\.roo(modes|rules)?(\/|$)", "", "Roo Code", None, False), (r"(^|\/)\.aider\.(chat|input)\.history", "", "Aider", None, True), (r"(^|\/)\.aider[^\/]*$", "", "Aider", None, False), (r"(^|\/)\.continue\/", "", "Continue", None, False),
    (r"(^|\/)\.kiro\/", "", "Kiro", None, False), (r"(^|\/)\.junie\/", "", "Junie (JetBrains)", None, False), (r"(^|\/)\.specstory\/", "", "SpecStory", None, True), (r"(^|\/)\.mcp\.json$", "", "Serveurs MCP pour assistant", None, False),
)
COMMITS = (
    (r"co-authored-by:[^\n]*(claude|anthropic)|generated with \[?claude code|noreply@anthropic\.com", "Claude Code", "claude"), (r"copilot-swe-agent|co-authored-by:[^\n]*copilot", "GitHub Copilot", "copilot"), (r"chatgpt-codex-connector|co-authored-by:[^\n]*\bcodex\b", "Codex (OpenAI)", "chatgpt"),
    (r"google-labs-jules|co-authored-by:[^\n]*\bjules\b", "Jules (Google)", "gemini"), (r"co-authored-by:[^\n]*gemini", "Gemini", "gemini"), (r"cursoragent@cursor\.com|co-authored-by:[^\n]*cursor", "Cursor", None), (r"\(aider\)|^aider: ", "Aider", None), (r"devin-ai-integration", "Devin", None),
    (r"generated (?:by|with) (?:an? )?(?:ai\b|chatgpt|gpt-?\d|copilot|cursor|gemini|windsurf)", "assistant non précisé", None),
)


def _all(*found: Column) -> Column:
    return F.filter(F.array(*found), lambda s: s.isNotNull())


def _none() -> Column:
    return F.array().cast(f"array<{SIGNAL}>")


def metadata(raw: Column, kind: Column, n_words: Column) -> Column:
    """Signals of the facts about a PDF or Word file."""
    at = lambda k: F.try_element_at(raw, F.lit(k))
    is_ = lambda c, p: F.coalesce(c.rlike(java(p, "i")), F.lit(False))
    hints = []
    for key, how in FIELDS:
        v = at(key)
        strong = is_(v, EXPORT_TITLE) if how == "content" else F.lit(True)
        counts = is_(v, EXACT_NAME) if how == "person" else is_(v, EXPORT_TITLE) | is_(v, CONTENT_NAME) | is_(v, OTHER_TOOLS) if how == "content" else F.lit(True)
        vendor = vendor_of(v, VENDOR_PATTERNS)
        hints.append(F.when(counts & (vendor.isNotNull() | is_(v, OTHER_TOOLS)), F.struct(vendor.alias("vendor"), F.when(strong, 3).otherwise(1).alias("weight"))))
    named = F.filter(F.array(*hints), lambda h: h.isNotNull())
    tool_level = F.exists(named, lambda h: h.weight == 3)
    vendors = F.array_distinct(F.filter(named, lambda h: h.vendor.isNotNull() & ~F.exists(named, lambda o: (o.vendor == h.vendor) & (o.weight > h.weight))))
    generator = vendor_of(at("c2pa.generator"), VENDOR_PATTERNS)
    common = _all(
        F.when(F.size(named) > 0, signal(META, "meta-ai-name", "metadata", F.when(tool_level, "fort").otherwise("moyen"), "ia", F.when(tool_level, 40).otherwise(12), None, vendors)),
        F.when(is_(at("xmp.digitalsourcetype"), AI_SOURCE), signal(META + 1, "meta-iptc-ai", "metadata", "fort", "ia", 45)),
        F.when(at("c2pa") == "1", signal(META + 2, "meta-c2pa", "metadata", F.when(generator.isNotNull(), "fort").otherwise("moyen"), "ia", F.when(generator.isNotNull(), 35).otherwise(15), None, F.when(generator.isNotNull(), F.array(F.struct(generator.alias("vendor"), F.lit(3).alias("weight")))).otherwise(F.array().cast("array<struct<vendor:string,weight:int>>")))),
    )
    tool = F.array_join(F.array(at("pdf.producer"), at("pdf.creator"), at("xmp.creatortool"), at("xmp.producer")), " · ")
    headless = is_(at("pdf.creator"), r"headlesschrome|puppeteer|playwright") & is_(at("pdf.creator"), "linux") & is_(F.regexp_replace(at("pdf.creationdate"), r"\s", ""), UTC_DATE)
    made = F.when(F.lit(False), signal(META + 3, "", "metadata", "info", "neutre", 0))
    for p, points, strength, direction, v in GENERATORS:
        fires = is_(tool, p) | (at("pdf.reportlab") == "1") & ~is_(tool, "|".join(f"(?:{g[0]})" for g in GENERATORS)) if p == "reportlab" else is_(tool, p)
        made = made.when(F.coalesce(fires, F.lit(False)), signal(META + 3, "meta-pdf-generator", "metadata", strength, direction, points, None, v))
    defaults = sum((is_(at(k), p).cast("int") for k, p in (("pdf.author", r"^\(?anonymous\)?$"), ("pdf.title", r"^\(?(untitled|anonymous)\)?$"), ("pdf.subject", r"^\(?unspecified\)?$"), ("pdf.creator", r"^\(?unspecified\)?$"))), F.lit(0))
    utc = is_(F.regexp_replace(at("pdf.creationdate"), r"\s", ""), UTC_DATE) & ~is_(tool, r"microsoft|word|pages|quartz")
    of_pdf = _all(
        F.when(~headless | (made.points > 5), made), F.when(defaults >= 2, signal(META + 4, "meta-pdf-defaults", "metadata", "moyen", "ia", 8, None, (("script", 2),))),
        F.when(headless, signal(META + 5, "meta-headless-sandbox", "metadata", "moyen", "ia", 10, None, (("script", 2), ("claude", 1), ("chatgpt", 1)))), F.when(utc & ~headless, signal(META + 6, "meta-pdf-utc", "metadata", "faible", "ia", 5)),
        F.when((tool == "") & at("pdf.author").isNull() & at("pdf.title").isNull(), signal(META + 7, "meta-pdf-empty", "metadata", "info", "neutre", 2)),
    )
    lib = F.when(F.lit(False), signal(META + 8, "", "metadata", "info", "neutre", 0))
    places = F.filter(F.array(at("docx.creator"), at("docx.lastmodifiedby"), at("docx.description"), at("docx.application")), lambda v: v.isNotNull())
    for p, v in LIBRARIES:
        lib = lib.when(F.exists(places, lambda c: c.rlike(java(p, "i"))), signal(META + 8, "meta-docx-lib", "metadata", "fort", "ia", 32, None, v))
    app = F.coalesce(at("docx.application"), F.lit(""))
    word_like, no_lib = is_(app, r"word|libreoffice|openoffice|pages|wps|onlyoffice|google"), lib.isNull()
    minutes, marks = at("docx.totaltime").try_cast("double"), at("docx.rsids").try_cast("int")
    pace = F.try_divide(n_words, F.greatest(minutes, F.lit(1.0)))
    of_docx = _all(
        lib, F.when((at("docx.hasapp") == "0") | (app == ""), signal(META + 9, "meta-docx-noapp", "metadata", "moyen", "ia", 10, None, (("script", 1),))),
        F.when(no_lib & word_like & (n_words >= 200) & (pace > 120), signal(META + 10, "meta-docx-paste", "metadata", "moyen", "ia", 12)).when(no_lib & word_like & (n_words >= 200) & (pace < 20) & (minutes >= 20), signal(META + 10, "meta-docx-worked", "metadata", "faible", "humain", -8)),
        F.when(no_lib & is_(app, "word") & (marks == 0), signal(META + 11, "meta-docx-norsid", "metadata", "moyen", "ia", 10, None, (("script", 1),))).when(no_lib & is_(app, "word") & (marks >= 6), signal(META + 11, "meta-docx-sessions", "metadata", "faible", "humain", -6)),
    )
    return F.when(kind == "pdf", F.concat(common, of_pdf)).when(kind == "docx", F.concat(common, of_docx)).otherwise(_none())


def assistant_tool(path: Column) -> Column:
    """(tool, vendor, transcript) that a path of a project belongs to; null for others."""
    out = F.when(F.lit(False), F.struct(F.lit("").alias("tool"), F.lit(None).cast("string").alias("vendor"), F.lit(False).alias("transcript")))
    for p, flags, tool, vendor, transcript in ASSISTANT_FILES:
        out = out.when(path.rlike(java(p, flags)), F.struct(F.lit(tool).alias("tool"), F.lit(vendor).cast("string").alias("vendor"), F.lit(transcript).alias("transcript")))
    return out


def commit_tool(commit: Column) -> Column:
    """(tool, vendor) that a commit, as `author <email>` and message, names."""
    out = F.when(F.lit(False), F.struct(F.lit("").alias("tool"), F.lit(None).cast("string").alias("vendor")))
    for p, tool, vendor in COMMITS:
        out = out.when(commit.rlike(java(p, "im")), F.struct(F.lit(tool).alias("tool"), F.lit(vendor).cast("string").alias("vendor")))
    return out


def _hints(tools: Column) -> Column:
    return F.transform(F.array_distinct(F.filter(F.transform(tools, lambda t: t.vendor), lambda v: v.isNotNull())), lambda v: F.struct(v.alias("vendor"), F.lit(3).alias("weight")))


def project(paths: Column, commits: Column) -> Column:
    """Signals of a project: files of assistants, and commits that assistants signed (null: no history)."""
    tools = F.filter(F.transform(paths, lambda p: assistant_tool(p)), lambda t: t.isNotNull())
    logs, configs = F.filter(tools, lambda t: t.transcript), F.filter(tools, lambda t: ~t.transcript)
    signed = F.filter(F.transform(commits, lambda c: commit_tool(c)), lambda t: t.isNotNull())
    return _all(
        F.when(F.size(logs) > 0, signal(PROJECT, "project-assistant-transcript", "project", "fort", "ia", 40, F.size(logs), _hints(logs))), F.when(F.size(configs) > 0, signal(PROJECT + 1, "project-assistant-files", "project", "fort", "ia", 30, F.size(configs), _hints(configs))),
        F.when(commits.isNull(), signal(PROJECT + 2, "project-git-missing", "project", "info", "neutre", 0)).when(F.size(signed) == 0, signal(PROJECT + 2, "project-git-clean", "project", "info", "neutre", 0)).otherwise(signal(PROJECT + 2, "project-git-assistant", "project", "fort", "ia", 40, F.size(signed), _hints(signed))),
    )


# fixed values: what assistants leave in code (id, pattern, flags, least in a file, strength, points)
CODE_RULES = (
    ("code-chat", r"here(?:'s| is) the (?:updated|complete|full|corrected|fixed|revised) (?:code|version|script)|voici (?:le|la) (?:code|version|script) (?:complet|complète|corrigée?|mise? à jour)", "i", 1, "fort", 30),
    ("code-placeholders", r"your[_-]?api[_-]?key|YOUR_[A-Z_]+_HERE|your_[a-z_]+_here|<your[-_ ][a-z ]+>|path\/to\/your|replace with your|remplace[rz]? (?:par|avec) (?:ton|ta|tes|votre|vos)|(?:#|\/\/)\s*(?:example usage|exemple d['’]utilisation|usage example)", "i", 1, "moyen", 14),
    ("code-steps", r"^\s*(?:#|\/\/|--)\s*(?:step|étape)\s*\d+", "im", 2, "faible", 8),
    ("code-narration", r"^\s*(?:#|\/\/)\s*(?:let['’]s|now (?:we|let['’]s)|this (?:function|will|is|code)|here we|ici,? on|maintenant,? on|on va|cette fonction)", "im", 3, "faible", 6),
    ("code-emoji-logs", r"""(?:print|console\.(?:log|error|warn|info)|echo|logger\.\w+|log\.\w+)\s*\(?\s*f?["'`][^"'`\n]*(?:[\u{1F300}-\u{1FAFF}]|✅|❌|⚠️|✔|✓)""", "", 2, "faible", 8),
)
HASH_COMMENTS = ("py", "sh", "bash", "zsh", "rb", "yml", "yaml", "toml", "r", "pl", "ps1", "conf")
TYPOGRAPHY = "[—–→←⇒≠≈≤≥…«»“”’]"
BANNER = r"^\s*(?:\/\*\*?|\/\/|#)?\s*\*?\s*(?!TODO|FIXME|NOTE|HACK|XXX|WARNING|IMPORTANT)[A-ZÀ-Ý][A-ZÀ-Ý0-9'\/]{2,}(?: [A-ZÀ-Ý0-9'\/]+)*\s*[—–]\s+\S[^\n]*"


def comments(t: Column, extension: Column) -> Column:
    """The comments of a source file: after # in some languages, else after // or between /* and */."""
    hashes = F.regexp_extract_all(t, F.lit(java(r"(?:^|\s)#(?![!{])[^\n]*", "m")), 0)
    slashes = F.regexp_extract_all(t, F.lit(java(r"\/\/[^\n]*|\/\*[\s\S]*?\*\/")), 0)
    return F.when(F.coalesce(extension.isin(*HASH_COMMENTS), F.lit(False)), hashes).otherwise(slashes)


# fixed values: words of comments that say nothing, and beginnings of French words with the English names they stand for
SILENT = "the and for with from into are its this that these those our all any each new then else when not out via les des une aux dans sur pour par avec est sont cet cette ces qui que ses son leur nouveau nouvelle tous toutes puis".split()
FRENCH = {
    "récup": "get fetch retrieve load", "cré": "create new make build", "mise": "update set", "mettre": "update set", "supprim": "delete remove destroy", "vérif": "check is has validate verify", "ajout": "add push append insert",
    "initialis": "init setup", "utilisateur": "user", "affich": "show display render", "charg": "load fetch", "envo": "send post submit", "calcul": "compute calculate calc", "défini": "set define", "retourn": "return", "renvoi": "return",
    "gère": "handle", "gérer": "handle", "gestion": "handle manage", "erreur": "error err", "donnée": "data", "fichier": "file", "réponse": "response res", "requête": "request req query", "nombre": "count number num", "état": "state status",
    "valeur": "value val", "clé": "key", "élément": "item element", "formulaire": "form", "bouton": "button btn", "liste": "list items", "tableau": "array table", "connexion": "connect login", "titre": "title", "chemin": "path", "tri": "sort",
    "filtr": "filter", "parcour": "for each map", "boucle": "for loop while", "ferm": "close", "ouvr": "open", "lire": "read", "écri": "write", "enregistr": "save store", "sauvegard": "save",
}
TOOLING = r"^(todo|fixme|hack|xxx|eslint|prettier|@ts-|ts-|noqa|type:|pylint|istanbul|c8|biome|region|endregion|#)"
HASH_ONLY = ("py", "sh", "bash", "zsh", "rb", "r", "pl", "ps1", "yml", "yaml", "toml")
MARKUP = ("html", "htm", "vue", "svelte", "xml")


def comment_of(line: Column, extension: Column) -> Column:
    """What a line that is all comment says; null for other lines."""
    said = lambda p: F.when(line.rlike(java(p)), F.regexp_extract(line, java(p), 1))
    is_in = lambda names: F.coalesce(extension.isin(*names), F.lit(False))
    slashes, stars, tags = said(r"^\s*\/\/\s*(.*?)\s*$"), said(r"^\s*\{?\/\*+\s*(.*?)\s*\*\/\}?\s*$"), said(r"^\s*<!--\s*(.*?)\s*-->\s*$")
    own = F.when(is_in(HASH_ONLY), said(r"^\s*#(?!!)\s*(.*?)\s*$")).otherwise(slashes)
    return F.coalesce(own, F.when(is_in(("php",)), said(r"^\s*#(?!\[)\s*(.*?)\s*$")), stars, F.when(is_in((*MARKUP, "php")), tags))


def content_words(comment: Column) -> Column:
    return F.filter(F.regexp_extract_all(F.lower(comment), F.lit("[a-zà-ÿ]+"), 0), lambda w: (F.length(w) >= 3) & ~w.isin(*SILENT))


def code_parts(line: Column) -> Column:
    """The words that the names in a line of code are made of."""
    names = F.regexp_extract_all(line, F.lit(r"[A-Za-z_$][A-Za-z0-9_$]*"), 0)
    parts = F.flatten(F.transform(names, lambda n: F.split(n, r"(?<=[a-z0-9])(?=[A-Z])|[_$]+")))
    return F.array_distinct(F.transform(F.filter(parts, lambda p: F.length(p) >= 2), F.lower))


def _says(word: Column, parts: Column) -> Column:
    """Whether a word of a comment names one of the parts, in English or French."""
    w = F.when((F.length(word) > 3) & word.endswith("s"), F.left(word, F.length(word) - 1)).otherwise(word)
    same = F.exists(parts, lambda p: (p == w) | (p == word) | (F.length(w) >= 4) & (F.length(p) >= 4) & (p.startswith(w) | w.startswith(p)))
    means = F.when(F.lit(False), F.array().cast("array<string>"))
    for stem, names in FRENCH.items():
        means = means.when(word.startswith(stem), F.array(*map(F.lit, names.split())))
    return same | F.coalesce(F.arrays_overlap(means, parts), F.lit(False))


def paraphrases(t: Column, extension: Column) -> Column:
    """Places (line, code: line numbers from 1) of comments that repeat the next line of code; null while they are few.

    A comment counts if it stands alone, has two to eight words that say something, and code follows within two lines.
    """
    lines = F.split(t, "\n", -1)
    said = F.transform(F.array(lines), lambda ls: F.transform(ls, lambda x: F.struct(x.alias("line"), comment_of(x, extension).alias("said"))))

    def found(ls: Column) -> Column:
        at = lambda i: F.get(ls, i)
        blank = lambda i: F.coalesce(at(i).line.rlike(rf"^[{WS}]*\z"), F.lit(False))

        def one(x: Column, i: Column) -> Column:
            follows = F.when(~blank(i + 1), i + 1).otherwise(i + 2)
            code = F.when(blank(follows), None).otherwise(at(follows))
            alone = x.said.isNotNull() & (F.when(i > 0, at(F.greatest(i - 1, F.lit(0))).said.isNull()).otherwise(True))
            plain = ~x.said.rlike(java(TOOLING, "i")) & ~x.said.rlike("[;{}=()<>]")
            told = F.array(F.struct(content_words(x.said).alias("ws"), code_parts(code.line).alias("parts")))  # made once for each comment
            size = lambda e: F.size(e.ws)
            same = lambda e: F.size(F.filter(e.ws, lambda w: _says(w, e.parts))) >= 0.66 * size(e)
            judged = F.transform(told, lambda e: F.when((size(e) >= 2) & (size(e) <= 8), F.struct((i + 1).alias("line"), (follows + 1).alias("code"), same(e).alias("same"))))
            return F.when(alone & plain & code.line.isNotNull() & code.said.isNull(), F.element_at(judged, 1))

        return F.filter(F.transform(ls, one), lambda x: x.isNotNull())

    def enough(x: Column) -> Column:
        same = F.filter(x, lambda e: e.same)
        return F.when((F.size(same) >= 3) & (F.size(x) >= 4) & (F.size(same) >= 0.3 * F.size(x)), F.transform(same, lambda e: F.struct(e.line, e.code)))

    return F.element_at(F.transform(F.transform(said, found), enough), 1)


def project_code(files: DataFrame, key: str, text: str = "text", extension: str = "extension") -> DataFrame:
    """(key, files, signals): code signals of whole projects. files: a row for each source file.

    A rule counts in the files where it fires by itself; counts and files are summed with partial aggregation, so a
    project of any size travels as one row a rule and task.
    """
    own = files.select(key, code(F.coalesce(F.col(text), F.lit("")), F.col(extension)).alias("s"))
    n = files.groupBy(key).agg(F.count("*").alias("files"))
    rank = F.when(F.col("s.strength") == "fort", 3).when(F.col("s.strength") == "moyen", 2).otherwise(1)
    hit = own.select(key, F.explode("s").alias("s")).groupBy(key, "s.id").agg(F.sum(F.coalesce("s.count", F.lit(1))).alias("count"), F.count("*").alias("in_files"), F.max_by("s", rank * 1000 + F.col("s.points")).alias("s"))
    summed = F.struct(*[F.col(f"s.{c}") for c in ("seq", "id", "category", "strength", "direction", "points", "vendors")], F.col("count")).cast(SIGNAL)
    per = hit.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.col("s.seq").alias("o"), summed.alias("s"), F.col("in_files").alias("n")))).alias("x"))
    out = n.join(per, key, "left")
    return out.select(key, "files", F.coalesce(F.transform("x", lambda e: e.s), _none()).alias("signals"), F.coalesce(F.transform("x", lambda e: e.n), F.array().cast("array<bigint>")).alias("in_files"))


def first_line(message: Column) -> Column:
    return F.left(trimmed(F.element_at(F.split(message, "\n"), 1)), F.lit(90))


def commits_by_tool(commits: DataFrame, key: str) -> DataFrame:
    """(key, tool, vendor, commits, total, first): signed commits of each tool, of all read, and the first two as
    evidence. commits: key, ord, author, email, message."""
    said = commits.withColumn("_t", commit_tool(F.concat("author", F.lit(" <"), "email", F.lit(">\n"), "message")))
    total = said.groupBy(key).agg(F.count("*").alias("total"))
    w = Window.partitionBy(key, "_tool").orderBy("ord")
    signed = said.where("_t is not null").withColumn("_tool", F.col("_t.tool"))
    line = F.concat(F.col("_tool"), F.lit(" : « "), first_line(F.col("message")), F.lit(" »"))
    two = signed.withColumn("_k", F.row_number().over(w)).where("_k <= 2").groupBy(key, "_tool").agg(F.sort_array(F.collect_list(F.struct("ord", line.alias("e")))).alias("f"))
    counted = signed.groupBy(key, "_tool").agg(F.count("*").alias("commits"), F.first("_t.vendor").alias("vendor"))
    return counted.join(two, [key, "_tool"]).join(total, key).select(key, F.col("_tool").alias("tool"), "vendor", "commits", "total", F.transform("f", lambda x: x.e).alias("first"))


def shallowest_head(paths: Column) -> Column:
    """The .git/HEAD of a project with the shortest path, the first in the archive of equal ones; null without history."""
    heads = F.filter(paths, lambda p: p.rlike(r"(^|/)\.git/HEAD$"))
    keyed = F.transform(heads, lambda p, i: F.struct(F.length(p).alias("n"), i.alias("i"), p.alias("p")))
    return F.try_element_at(F.array_sort(keyed), F.lit(1)).p


def file_signals(kind: str = "kind", raw: str = "raw", extension: str = "extension", text: str = "text") -> Detector:
    """The detectors of a file's facts and code, for `detected(more=...)`: the table needs these columns and `words`."""

    def of(x: DataFrame) -> Column:
        of_code = F.when(F.col(kind) == "code", code(F.coalesce(F.col(text), F.lit("")), F.col(extension))).otherwise(_none())
        return F.concat(F.coalesce(metadata(F.col(raw), F.col(kind), F.col("words")), _none()), F.coalesce(of_code, _none()))

    return of


def project_signals(paths: str = "paths", commits: str = "commits") -> Detector:
    """The detector of a project's paths and commits; rows without paths are no projects."""
    return lambda x: F.when(F.col(paths).isNotNull(), project(F.col(paths), F.col(commits))).otherwise(_none())


def code(t: Column, extension: Column) -> Column:
    """Signals of one source file; a project's files are rows of their own, whose signals are summed up by project."""
    marks = F.filter(F.split(F.array_join(comments(t, extension), " "), ""), lambda c: c.rlike(f"^{TYPOGRAPHY}$"))
    n, kinds = F.size(marks), F.size(F.array_distinct(marks))
    strong = (n >= 6) | (kinds >= 3)
    both = (("chatgpt", 1), ("claude", 1))
    rules_ = [F.when(F.regexp_count(t, F.lit(java(p, flags))) >= least, signal(CODE + i, id_, "code", strength, "ia", points, F.regexp_count(t, F.lit(java(p, flags))))) for i, (id_, p, flags, least, strength, points) in enumerate(CODE_RULES)]
    return _all(
        *rules_, F.when((n >= 3) | (kinds >= 2), signal(CODE + 10, "code-typography", "code", F.when(strong, "moyen").otherwise("faible"), "ia", F.when(strong, 22).otherwise(12), n, both)),
        F.when(F.left(t, F.lit(800)).rlike(java(BANNER, "m")), signal(CODE + 11, "code-banner", "code", "moyen", "ia", 22, None, both)),
        F.element_at(F.transform(F.array(paraphrases(t, extension)), lambda p: F.when(p.isNotNull(), signal(CODE + 12, "code-paraphrase", "code", "faible", "ia", 10, F.size(p)))), 1),
    )


# fixed values: what the facts are called in a report's table, in its order; a date is shown as such
SHOWN_PDF = (("pdf.producer", "Producteur (Producer)"), ("pdf.creator", "Créateur (Creator)"), ("pdf.author", "Auteur"), ("pdf.title", "Titre"), ("pdf.subject", "Sujet"), ("pdf.keywords", "Mots-clés"), ("pdf.creationdate", "Créé le"), ("pdf.moddate", "Modifié le"), ("xmp.creatortool", "XMP · Outil créateur"), ("xmp.producer", "XMP · Producteur"), ("xmp.digitalsourcetype", "XMP · Source numérique (IPTC)"))
SHOWN_DOCX = (
    ("docx.creator", "Créateur (auteur)"), ("docx.lastmodifiedby", "Modifié par"), ("docx.title", "Titre"), ("docx.subject", "Sujet"), ("docx.description", "Description"), ("docx.created", "Créé le"), ("docx.modified", "Modifié le"), ("docx.revision", "Révision"), ("docx.application", "Application"),
    ("docx.appversion", "Version application"), ("docx.totaltime", "Temps total d'édition"), ("docx.words", "Mots (selon le logiciel)"), ("docx.company", "Société"), ("docx.template", "Modèle"), ("docx.rsids", "Sessions d'édition Word (rsid)"), ("docx.custom", "Propriétés personnalisées"),
)
SHOWN_TEXT = (("file.encoding", "Encodage"), ("file.lineendings", "Fins de ligne"))
NAMED_AS = {"pdf.producer": "Producteur", "pdf.creator": "Créateur", "pdf.author": "Auteur", "docx.creator": "Auteur", "pdf.title": "Titre", "docx.title": "Titre", "pdf.subject": "Sujet", "pdf.keywords": "Mots-clés", "xmp.creatortool": "Outil créateur (XMP)", "docx.lastmodifiedby": "Modifié par", "docx.description": "Description", "docx.application": "Application", "docx.company": "Société", "docx.template": "Modèle", "docx.custom": "Propriétés personnalisées", "c2pa.generator": "Générateur C2PA"}


def metadata_rows(raw: Column, kind: Column) -> Column:
    """(key, value) of a file's facts as a report shows them, without those that it lacks."""
    at = lambda k: F.nullif(F.try_element_at(raw, F.lit(k)), F.lit(""))

    def value(key: str) -> Column:
        if key in ("pdf.creationdate", "pdf.moddate"):
            return pdf_date(at(key))
        if key == "docx.totaltime":
            return F.concat(at(key), F.lit(" min"))
        if key == "docx.application":
            return F.when(at("docx.hasapp") == "1", F.coalesce(at(key), F.lit("(non renseignée)"))).otherwise("(fiche application absente)")
        return at(key)

    rows = lambda shown: F.array(*[F.struct(F.lit(label).alias("key"), value(key).alias("value")) for key, label in shown])
    c2pa = F.array(F.struct(F.lit("C2PA (Content Credentials)").alias("key"), F.when(at("c2pa") == "1", F.concat(F.lit("présent"), F.coalesce(F.concat(F.lit(" ("), at("c2pa.generator"), F.lit(")")), F.lit("")))).alias("value")))
    every = F.when(kind == "pdf", F.concat(rows(SHOWN_PDF), c2pa)).when(kind == "docx", rows(SHOWN_DOCX)).otherwise(rows(SHOWN_TEXT))
    return F.filter(every, lambda m: m.value.isNotNull())


def metadata_evidence(raw: Column, signals: Column) -> Column:
    """What the metadata signals that speak for an assistant rest on."""
    at = lambda k: F.nullif(F.try_element_at(raw, F.lit(k)), F.lit(""))
    is_ = lambda c, p: F.coalesce(c.rlike(java(p, "i")), F.lit(False))
    fired = lambda *ids: F.exists(signals, lambda s: s.id.isin(*ids) & (s.direction == "ia"))
    named = []
    for key, how in FIELDS:
        v = at(key)
        counts = is_(v, EXACT_NAME) if how == "person" else is_(v, EXPORT_TITLE) | is_(v, CONTENT_NAME) | is_(v, OTHER_TOOLS) if how == "content" else F.lit(True)
        named.append(F.when(counts & (vendor_of(v, VENDOR_PATTERNS).isNotNull() | is_(v, OTHER_TOOLS)), F.concat(F.lit(f"{NAMED_AS[key]} : « "), F.left(v, F.lit(120)), F.lit(" »"))))
    tool = F.array_join(F.filter(F.array(at("pdf.producer"), at("pdf.creator"), at("xmp.creatortool"), at("xmp.producer")), lambda t: t.isNotNull()), " · ")
    some = lambda when, *values: F.when(when, F.array(*values)).otherwise(F.array().cast("array<string>"))
    facts = lambda pairs: [F.concat(F.lit(f"{label} : « "), at(k), F.lit(" »")) for k, label in pairs]
    every = F.concat(
        F.slice(F.filter(F.array(*named), lambda e: e.isNotNull()), 1, 5), some(fired("meta-iptc-ai"), at("xmp.digitalsourcetype")), some(fired("meta-c2pa"), F.concat(F.lit("Générateur : "), at("c2pa.generator"))),
        some(fired("meta-pdf-generator"), F.when(tool == "", "commentaire « ReportLab Generated PDF document »").otherwise(tool)),
        some(fired("meta-pdf-defaults"), *[F.when(is_(at(k), p), F.concat(F.lit(f"{label} = « "), at(k), F.lit(" »"))) for k, p, label in (("pdf.author", r"^\(?anonymous\)?$", "Auteur"), ("pdf.title", r"^\(?(untitled|anonymous)\)?$", "Titre"), ("pdf.subject", r"^\(?unspecified\)?$", "Sujet"), ("pdf.creator", r"^\(?unspecified\)?$", "Créateur"))]),
        some(fired("meta-headless-sandbox"), at("pdf.creator"), at("pdf.creationdate")), some(fired("meta-pdf-utc"), at("pdf.creationdate")),
        some(fired("meta-docx-lib"), *facts((("docx.creator", "Créateur"), ("docx.lastmodifiedby", "Modifié par"))), F.concat(F.lit("Description : « "), F.left(at("docx.description"), F.lit(80)), F.lit(" »"))),
    )
    return F.filter(every, lambda e: e.isNotNull())


def warnings_of(metadata: Column) -> Column:
    """The rows of a report's table that are warnings."""
    return F.transform(F.filter(metadata, lambda m: m.key == "Avertissement"), lambda m: m.value)
