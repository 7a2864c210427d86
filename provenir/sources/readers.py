"""Readers: files as binaryFile rows (path, content) to document rows, distributed by file.

A document row is (path, kind, filename, extension, size, text, raw MAP<STRING,STRING>, urls ARRAY<STRING>, error). A file
that can't be read becomes a row with an error, never a failed job. Office files and archives are opened with the
standard library; of PDF files the metadata are read, their page text needs a library that is not required here.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "path string, kind string, filename string, extension string, size long, text string, raw map<string,string>, urls array<string>, error string"
MAX_FILE, MAX_ARCHIVE, MAX_URLS = 25 << 20, 100 << 20, 500
PROJECT_TEXT, PROJECT_FILE = 380_000, 60_000
# fixed values: kinds by extension
TEXT_EXT = frozenset("txt text log csv tsv rtf srt vtt".split())
MD_EXT = frozenset("md markdown mdx rst adoc".split())
CODE_EXT = frozenset("js mjs cjs ts tsx jsx py java kt kts scala cs c h cpp hpp cc go rs rb php swift m mm dart lua pl r sql sh bash zsh ps1 bat cmd html htm css scss less vue svelte json yaml yml toml xml ini gradle ipynb dockerfile tf".split())
REJECTED = frozenset("doc odt pages xlsx pptx".split())
IGNORED = re.compile(r"(^|/)(node_modules|dist|build|out|target|vendor|venv|\.venv|__pycache__|\.next|\.nuxt|coverage|\.idea|\.vscode|__MACOSX)/")
URL = re.compile(r"""https?://[^\s)\]"'<>]+""")


def pasted(df: DataFrame, text: str = "text") -> DataFrame:
    """Pasted texts: line ends as \\n, size in UTF-8 bytes, kind text."""
    t = F.regexp_replace(text, "\r\n?", "\n")
    return df.withColumn(text, t).withColumn("kind", F.lit("text")).withColumn("size", F.octet_length(text).cast("long"))


def repaired_name(name: Column) -> Column:
    """A file name whose UTF-8 bytes were read as Latin-1, put right."""
    return F.decode(F.encode(name, "ISO-8859-1"), "UTF-8")


def decoded(content: bytes) -> tuple[str, str]:
    """Text and name of its encoding: by byte order mark, else UTF-8 if valid, else Windows-1252."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        if content.startswith(mark):
            return content[len(mark) :].decode(name, "replace"), name
    try:
        return content.decode("utf-8"), "utf-8"
    except UnicodeDecodeError:
        return content.decode("cp1252", "replace"), "windows-1252"


def is_text(content: bytes) -> bool:
    head = content[:4096]
    return not head or sum(b < 32 and b not in (9, 10, 12, 13, 27) for b in head) < 0.02 * len(head)


def plain(content: bytes) -> tuple[str, dict[str, str]]:
    t, name = decoded(content)
    crlf, lf = t.count("\r\n"), t.count("\n") - t.count("\r\n")
    ends = "CRLF" if crlf > lf else "LF" if lf else "none"
    return re.sub(r"\r\n?", "\n", t), {"file.encoding": name, "file.lineendings": ends}


_CORE = {"creator": "creator", "lastModifiedBy": "lastmodifiedby", "description": "description", "title": "title", "subject": "subject", "created": "created", "modified": "modified", "revision": "revision"}
_APP = {"Application": "application", "AppVersion": "appversion", "TotalTime": "totaltime", "Company": "company", "Template": "template", "Words": "words"}


def docx(content: bytes) -> tuple[str, dict[str, str], list[str]]:
    """Text, facts and links of a Word file."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        part = lambda n: z.read(n) if n in z.namelist() else None
        body, core, app, settings, custom, links = (part(n) for n in ("word/document.xml", "docProps/core.xml", "docProps/app.xml", "word/settings.xml", "docProps/custom.xml", "word/_rels/document.xml.rels"))
    if body is None:
        raise ValueError("no word/document.xml")
    local = lambda e: e.tag.rpartition("}")[2]
    lines = []
    for p in ElementTree.fromstring(body).iter():
        if local(p) == "p":
            lines.append("".join("\t" if local(e) == "tab" else "\n" if local(e) == "br" else e.text or "" for e in p.iter() if local(e) in ("t", "tab", "br")))
    raw = {"docx.hasapp": "0" if app is None else "1"}
    for source, names in ((core, _CORE), (app, _APP)):
        for e in ElementTree.fromstring(source).iter() if source else ():
            if local(e) in names and (e.text or "").strip():
                raw[f"docx.{names[local(e)]}"] = e.text.strip()
    marks = {*re.findall(rb'w:rsid\w*="([0-9A-Fa-f]{8})"', settings or b"")} | {*re.findall(rb'w:rsid w:val="([0-9A-Fa-f]{8})"', settings or b"")}
    raw["docx.rsids"] = str(len(marks or {*re.findall(rb'w:rsid\w*="([0-9A-Fa-f]{8})"', body)}))
    if custom:
        raw["docx.custom"] = " ".join(t.strip() for t in ElementTree.fromstring(custom).itertext() if t.strip())
    text = "\n\n".join(lines)
    urls = [m.decode() for m in re.findall(rb'Target="(https?://[^"]+)"', links or b"")]
    return text, raw, (urls + URL.findall(text))[:MAX_URLS]


def pdf_string(value: bytes) -> str:
    """A literal or hexadecimal string of a PDF file."""
    if value.startswith(b"<"):
        data = bytes.fromhex(re.sub(rb"[^0-9A-Fa-f]", b"", value).decode().ljust(len(value) % 2, "0")) if value else b""
    else:
        plain_ = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
        data = re.sub(rb"\\([0-7]{1,3}|.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() else plain_.get(m[1], m[1]), value[1:-1], flags=re.S)
    return (data[2:].decode("utf-16-be", "replace") if data.startswith(b"\xfe\xff") else data.decode("latin-1")).strip()


def pdf(content: bytes) -> tuple[str, dict[str, str], list[str]]:
    """Facts and links of a PDF file: its information dictionary, XMP packet and provenance marks."""
    raw: dict[str, str] = {}
    for name in ("Producer", "Creator", "Author", "Title", "Subject", "Keywords", "CreationDate", "ModDate"):
        m = re.search(rb"/" + name.encode() + rb"\s*(\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]*>)", content, re.S)
        if m and (v := pdf_string(m[1])):
            raw[f"pdf.{name.lower()}"] = v
    for key, pattern in (("xmp.creatortool", rb"<xmp:CreatorTool>([^<]+)<"), ("xmp.producer", rb"<pdf:Producer>([^<]+)<"), ("xmp.digitalsourcetype", rb"DigitalSourceType[^>]*?(?:>|=\")([^<\"]+)")):
        if m := re.search(pattern, content):
            raw[key] = m[1].decode("utf-8", "replace").strip()
    if b"c2pa" in content and (b"jumb" in content or b"C2PA" in content):
        raw["c2pa"] = "1"
        if m := re.search(rb"claim_generator[^\x20-\x7e]*([\x20-\x7e]{3,80})", content):
            raw["c2pa.generator"] = m[1].decode().strip()
    if b"ReportLab Generated PDF" in content[:2000]:
        raw["pdf.reportlab"] = "1"
    return "", raw, [u.decode("latin-1") for u in re.findall(rb"/URI\s*\((https?://[^)]+)\)", content)][:MAX_URLS]


def project(content: bytes) -> tuple[str, list[tuple[str, str]], list[str]]:
    """Concatenated text, (path, text) of the source files within the budget, and all paths of a zipped project."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        paths = sorted(n for n in z.namelist() if not n.endswith("/") and not IGNORED.search(n))
        files, total, out = [], 0, []
        for n in paths:
            if extension_of(n) not in CODE_EXT | MD_EXT or "/.git/" in f"/{n}":
                continue
            data = z.read(n)
            t = plain(data)[0] if is_text(data) else ""
            if not t or len(t) > PROJECT_FILE or total + len(t) > PROJECT_TEXT:
                continue
            out.append(f"===== {n} =====\n{t}")
            total += len(t)
            files.append((n, t))
    return "\n\n".join(out), files, paths


def extension_of(name: str) -> str:
    base = name.rsplit("/", 1)[-1].lower()
    return "dockerfile" if base == "dockerfile" else base.rsplit(".", 1)[-1] if "." in base else ""


def read_one(path: str, content: bytes) -> tuple:
    """One document row."""
    name, ext = path.rsplit("/", 1)[-1], extension_of(path)
    row = lambda kind, text="", raw=None, urls=(), error=None: (path, kind, name, ext, len(content), text, raw or {}, list(urls), error)
    try:
        if len(content) > (MAX_ARCHIVE if ext == "zip" else MAX_FILE):
            return row(None, error="too large")
        if ext in REJECTED:
            return row(None, error=f"unsupported: {ext}")
        if content.startswith(b"%PDF-"):
            return row("pdf", *pdf(content))
        if content.startswith(b"PK\x03\x04") and ext not in CODE_EXT | MD_EXT | TEXT_EXT:  # by what is inside, whatever it is called
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                word = "word/document.xml" in z.namelist()
            if word:
                return row("docx", *docx(content))
        if ext == "docx":
            return row("docx", *docx(content))
        if ext == "zip" or content.startswith(b"PK\x03\x04"):
            text, _, paths = project(content)
            return row("code", text, {"project.paths": "\n".join(paths)})
        if not is_text(content):
            return row(None, error="not a text")
        text, raw = plain(content)
        kind = "md" if ext in MD_EXT else "code" if ext in CODE_EXT else "txt"
        return row(kind, text, raw, URL.findall(text)[:MAX_URLS]) if text.strip() else row(None, error="unreadable: no text")
    except (ValueError, KeyError, zipfile.BadZipFile, ElementTree.ParseError) as e:
        return row(None, error=f"{type(e).__name__}: {e}"[:200])


def read_files(files: DataFrame) -> DataFrame:
    """Document rows of binaryFile rows (path, content)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            yield pd.DataFrame([read_one(p, bytes(c)) for p, c in zip(x["path"], x["content"], strict=True)], columns=[c.split()[0] for c in SCHEMA.split(", ")])

    return files.select("path", "content").mapInPandas(run, SCHEMA)


PROJECT_FILES = "project string, path string, extension string, text string"


def read_projects(files: DataFrame) -> DataFrame:
    """(project, path, extension, text): the source files of zipped projects, a row each; other files have none."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            rows = []
            for p, c in zip(x["path"], x["content"], strict=True):
                try:
                    found = project(bytes(c))[1] if bytes(c[:4]) == b"PK\x03\x04" and len(c) <= MAX_ARCHIVE else []
                except (ValueError, KeyError, zipfile.BadZipFile):
                    found = []  # read_files gives the file's error
                rows += [(p, n, extension_of(n), t) for n, t in found]
            yield pd.DataFrame(rows, columns=["project", "path", "extension", "text"])

    return files.select("path", "content").mapInPandas(run, PROJECT_FILES)


def documents_in(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    return read_files(spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder))


def answers_of_batch(batch: DataFrame, text: str = "text") -> DataFrame:
    """Answers in a text of several, each after a line `===== pNN`: (prompt_id, answer), under 20 words left out."""
    parts = F.slice(F.split(text, r"(?m)^===== (?=p[0-9]+)"), 2, 2**31 - 1)
    x = batch.select(F.explode(parts).alias("part")).select(F.regexp_extract("part", r"^(p[0-9]+)", 1).alias("prompt_id"), F.regexp_replace("part", r"^p[0-9]+[^\n]*\n", "").alias("answer"))
    clean = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace("answer", r"(?m)^```.*$", ""), r"\*\*|__", ""), r"(?m)^#+ +", ""))
    return x.select("prompt_id", clean.alias("answer")).where(F.size(F.regexp_extract_all("answer", F.lit(r"\S+"), 0)) >= 20)
