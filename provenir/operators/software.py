"""Which programs made a file, by what its facts say, and the report's list of origins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import rules
from ..functions.rx import WS, java
from ..functions.text import once, trimmed
from .detect import vendor_of

SOFTWARE = "struct<name:string,confidence:int,source:string,note:string>"
ORIGIN = "struct<id:string,kind:string,score:int,level:string,reasons:array<string>>"
# fixed values: programs by what names them (pattern, name, note), first match first
KNOWN = (
    (r"reportlab", "ReportLab", "Bibliothèque Python utilisée par ChatGPT et Claude pour créer des PDF"), (r"matplotlib", "Matplotlib", "Graphiques Python, utilisés par ChatGPT et Claude en mode analyse"),
    (r"python-docx", "python-docx", "Bibliothèque Python utilisée par ChatGPT pour créer des .docx"), (r"^un-named$", "docx (JavaScript)", "Bibliothèque utilisée par Claude pour créer des .docx"),
    (r"weasyprint", "WeasyPrint", None), (r"wkhtmltopdf", "wkhtmltopdf", None), (r"xhtml2pdf|\bpisa\b", "xhtml2pdf", None), (r"fpdf", "FPDF", None), (r"pdfkit", "PDFKit", None), (r"jspdf", "jsPDF", None),
    (r"pdf-lib", "pdf-lib", None), (r"pdfmake", "pdfmake", None), (r"puppeteer", "Puppeteer", None), (r"playwright", "Playwright", None), (r"headlesschrome", "Chrome / Edge (impression PDF)", None), (r"prince", "Prince", None),
    (r"pandoc", "Pandoc", None), (r"typst", "Typst", None), (r"pikepdf", "pikepdf", None), (r"pymupdf|\bfitz\b", "PyMuPDF", None), (r"pypdf", "pypdf", None), (r"qpdf", "qpdf", None), (r"ghostscript", "Ghostscript", None),
    (r"aspose", "Aspose", None), (r"docx4j", "docx4j", None), (r"phpword", "PHPWord", None), (r"google docs", "Google Docs", None), (r"microsoft.{0,4}word|word for (?:office|microsoft)|microsoft office word|microsoft macintosh word", "Microsoft Word", None),
    (r"microsoft.{0,4}excel", "Microsoft Excel", None), (r"microsoft.{0,4}powerpoint", "Microsoft PowerPoint", None), (r"print to pdf", "Microsoft Print to PDF", None), (r"acrobat pdfmaker", "Adobe PDFMaker", None), (r"acrobat distiller", "Adobe Distiller", None),
    (r"indesign", "Adobe InDesign", None), (r"illustrator", "Adobe Illustrator", None), (r"photoshop", "Adobe Photoshop", None), (r"adobe acrobat", "Adobe Acrobat", None), (r"canva", "Canva", None), (r"\bpages\b", "Apple Pages", None), (r"keynote", "Apple Keynote", None),
    (r"libreoffice", "LibreOffice", None), (r"openoffice", "OpenOffice", None), (r"onlyoffice", "OnlyOffice", None), (r"\bwps office\b|kingsoft", "WPS Office", None), (r"skia\/pdf", "Chrome / Edge (impression PDF)", None), (r"safari", "Safari (impression PDF)", None),
    (r"firefox", "Firefox (impression PDF)", None), (r"cairo", "Cairo (bibliothèque graphique)", None), (r"quartz pdfcontext", "macOS (impression PDF)", None), (r"pdftex|xetex|luatex|latex", "LaTeX", None),
)
PLACEHOLDER = r"^\(?(?:unspecified|anonymous|untitled)\)?$"
# fixed values: facts that name a program, what they are called, and whether a person's name belongs there
FIELDS = (
    ("pdf.creator", "Créateur du PDF", False), ("xmp.creatortool", "Outil créateur (XMP)", False), ("pdf.producer", "Producteur du PDF", False), ("xmp.producer", "Producteur (XMP)", False),
    ("docx.application", "Application du .docx", False), ("docx.creator", "Créateur du .docx", True), ("docx.lastmodifiedby", "Modifié par", True), ("docx.description", "Description du .docx", True),
)
TEMPLATE = ", hérité du modèle par défaut de python-docx"
HEADER = "En-tête « ReportLab Generated PDF document »"
UNKNOWN = ("Programme non identifié", "Aucune application déclarée : fichier assemblé par un programme, pas enregistré par un traitement de texte")


def known(value: Column) -> Column:
    """(name, note) of the program that a value names; null if it names none."""
    out = F.when(F.lit(False), F.struct(F.lit("").alias("name"), F.lit(None).cast("string").alias("note")))
    for p, name, note in KNOWN:
        out = out.when(value.rlike(java(p, "i")), F.struct(F.lit(name).alias("name"), F.lit(note).cast("string").alias("note")))
    return out


def software_of(raw: Column) -> Column:
    """Programs that the facts name, in the order of FIELDS; one program's sources are joined."""
    at = lambda k: F.try_element_at(raw, F.lit(k))
    is_ = lambda c, p: F.coalesce(c.rlike(java(p, "i")), F.lit(False))
    from_template = is_(at("docx.creator"), "python-docx") | is_(at("docx.description"), "python-docx")
    hints = []
    for key, label, person in FIELDS:
        v = at(key)
        inherited = from_template if key == "docx.application" else F.lit(False)
        source = F.concat(F.lit(f"{label} : « "), F.left(v, F.lit(60)), F.lit(" »"), F.when(inherited, TEMPLATE).otherwise(""))
        squeezed = F.left(trimmed(F.regexp_replace(v, f"[{WS}]+", " ")), F.lit(40))
        hints.append(F.when((v != "") & ~is_(v, PLACEHOLDER), once(known(v), _hint(person, vendor_of(v, rules.VENDOR_PATTERNS), squeezed, inherited, source))))
    hints.append(F.when(at("pdf.reportlab") == "1", F.struct(F.lit("ReportLab").alias("name"), F.lit(95).alias("confidence"), F.lit(HEADER).alias("source"), F.lit(KNOWN[0][2]).alias("note"))))
    named = F.filter(F.array(*[h.cast(SOFTWARE) for h in hints]), lambda h: h.isNotNull())
    none = at("docx.hasapp").isNotNull() & (F.coalesce(at("docx.application"), F.lit("")) == "")
    unknown = F.struct(F.lit(UNKNOWN[0]).alias("name"), F.lit(60).alias("confidence"), F.lit(UNKNOWN[1]).alias("source"), F.lit(None).cast("string").alias("note")).cast(SOFTWARE)
    return once(named, lambda x: F.when((F.size(x) == 0) & none, F.array(unknown)).otherwise(_merged(x)))


def _hint(person: bool, vendor: Column, squeezed: Column, inherited: Column, source: Column):
    """What a fact says, given the program that it names; null if it is a person's or an assistant's name."""

    def of(hit: Column) -> Column:
        usable = hit.isNotNull() if person else hit.isNotNull() | vendor.isNull()
        return F.when(usable, F.struct(F.coalesce(hit["name"], squeezed).alias("name"), F.when(inherited, 10).otherwise(95).alias("confidence"), source.alias("source"), F.when(~inherited, hit["note"]).alias("note")))

    return of


def _merged(named: Column) -> Column:
    first = F.array_distinct(F.transform(named, lambda h: h["name"]))

    def joined(own: Column) -> Column:
        one = F.element_at(own, 1)
        return F.struct(one["name"].alias("name"), one["confidence"].alias("confidence"), F.array_join(F.array_distinct(F.transform(own, lambda h: h["source"])), " · ").alias("source"), one["note"].alias("note")).cast(SOFTWARE)

    return F.transform(F.transform(first, lambda n: F.filter(named, lambda h: h["name"] == n)), joined)


def origins(signals: Column, software: Column, probability: Column) -> Column:
    """The report's origins: programs, and every assistant with its share of the probability, by falling score.

    Without a probability assistants have no score and come last. Ties keep programs first, then the fixed order.
    """
    from .verdict import shares  # the same weights that origins_of gives as rows

    tools = F.transform(software, lambda t: F.struct(F.concat(F.lit("tool:"), F.lower(t["name"])).alias("id"), F.lit("logiciel").alias("kind"), t["confidence"].alias("score"), F.lit("trace").alias("level"), F.filter(F.array(t["source"], t["note"]), lambda r: r.isNotNull()).alias("reasons")).cast(ORIGIN))

    def own(x: Column) -> Column:
        reasons = lambda v: F.array_distinct(F.transform(F.filter(x, lambda s: (s.direction == "ia") & F.exists(s.vendors, lambda h: h.vendor == v)), lambda s: s.id))
        return F.transform(shares(x, probability), lambda e: F.struct(e.vendor.alias("id"), F.lit("ia").alias("kind"), e.score.alias("score"), e.level.alias("level"), reasons(e.vendor).alias("reasons")).cast(ORIGIN))

    keyed = F.transform(F.concat(tools, once(signals, own)), lambda o, i: F.struct((-F.coalesce(o.score, F.lit(-1))).alias("s"), i.alias("i"), o.alias("o")))
    return F.transform(F.array_sort(keyed), lambda k: k.o)
