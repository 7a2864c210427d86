"""Zipped projects: entries as rows, the source files that a report reads by a budget, and what a project is told by.

A task reads one archive (of readers.MAX_ARCHIVE at most) and yields its entries as rows. Which source files are read is a
greedy scan over the names and sizes of a project in the order that people sort names: a file that does not fit is passed
over, smaller ones after it may still fit, and the scan ends when the text is full. Only names and sizes pass the scan, which
holds one number for each project; each file gets its place in the project's text by it.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.files import assistant_tool
from .git import HEAD, MAX_COMMITS, commit_lines, git_folder, history, history_row
from .readers import MAX_ARCHIVE, PROJECT_FILE, PROJECT_TEXT, decoded, extension_of
from .shared import written

# fixed values: what is no source of a project, and what is, by extension
IGNORED = re.compile(r"(^|/)(node_modules|vendor|bower_components|dist|build|out|target|bin|obj|coverage|\.next|\.nuxt|\.output|\.svelte-kit|\.angular|\.turbo|\.cache|\.gradle|\.idea|\.venv|venv|__pycache__|Pods|__MACOSX|\.git)/")
IGNORED_FILES = re.compile(r"\.min\.[a-z]+$|\.d\.ts$|\.map$|(^|/)(package-lock\.json|yarn\.lock|pnpm-lock\.yaml|composer\.lock)$")
SOURCE = frozenset("js mjs cjs ts tsx jsx vue svelte py java kt kts scala cs c h cpp hpp cc go rs rb php swift m mm dart lua pl r sql sh bash zsh ps1 html htm css scss less".split())
LIBRARIES = r"(^|/)(node_modules|vendor)/"
NOTHING = "Aucun fichier source reconnu dans l'archive .zip."
BROKEN = "Archive .zip illisible ou corrompue."
HEADER = "===== {} =====\n"
ENTRIES = "project string, entries int, ord int, path string, extension string, source boolean, chars int, blank boolean, text string, error string"


def entries_of(project: str, content: bytes) -> Iterator[tuple]:
    """Rows of ENTRIES; of the .git folder only the HEAD that says where it is. A file beyond PROJECT_FILE has no text."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            every = [e for e in z.infolist() if not e.is_dir() and not e.filename.startswith("__MACOSX/")]
            head = f"{git_folder([e.filename for e in every]) or ''}HEAD"
            for i, e in enumerate(every):
                name = e.filename
                if "/.git/" in f"/{name}":
                    if HEAD.search(name) and name == head:
                        yield project, len(every), i, name, "", False, None, None, None, None
                    continue
                source = extension_of(name) in SOURCE and "." in name.rsplit("/", 1)[-1] and not IGNORED.search(name) and not IGNORED_FILES.search(name)
                text, chars = None, None
                if source:
                    large = e.file_size > 8 * PROJECT_FILE
                    text = None if large else decoded(z.read(e))[0].replace("\r\n", "\n").replace("\r", "\n")
                    chars = e.file_size if large else len(text)
                    text = text if chars <= PROJECT_FILE else None
                yield project, len(every), i, name, extension_of(name), source, chars, text is not None and not text.strip(), text, None
            if not every:
                yield project, 0, -1, None, None, False, None, None, None, None
    except (ValueError, KeyError, RuntimeError, NotImplementedError, zipfile.BadZipFile):
        yield project, 0, -1, None, None, False, None, None, None, BROKEN


def read_entries(files: DataFrame, rows: int = 200) -> DataFrame:
    """ENTRIES of binaryFile rows (path, content) that are archives."""
    names = [c.split()[0] for c in ENTRIES.split(", ")]
    frame = lambda held: pd.DataFrame(held, columns=names).astype({"chars": "Int64", "blank": "boolean"})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            for p, c in zip(x["path"], x["content"], strict=True):
                held = []
                for row in entries_of(p, bytes(c)) if bytes(c[:2]) == b"PK" and len(c) <= MAX_ARCHIVE else ():
                    held.append(row)
                    if len(held) == rows:
                        yield frame(held)
                        held = []
                yield frame(held)

    return files.select("path", "content").mapInPandas(run, ENTRIES)


def placed(sources: DataFrame, budget: int = PROJECT_TEXT, largest: int = PROJECT_FILE) -> DataFrame:
    """(project, ord, state, start, end): which source files are read (read, large, or left), and where each lies in the text.

    sources: project, ord, path, chars, blank. A file is read if it fits what is left of the budget with those before it; its
    name and a blank line count too.
    """

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, total = None, 0
        for x in frames:
            out = []
            for project, order, path, chars, blank in zip(x["project"], x["ord"], x["path"], x["chars"], x["blank"], strict=True):
                if project != at:
                    at, total = project, 0
                state, start = "left", None
                if total < budget and chars > largest:
                    state = "large"
                elif total < budget and not blank and total + chars <= budget:
                    state, start = "read", total + len(HEADER.format(path))
                    total = start + chars + 2
                out.append((project, order, state, start, None if start is None else start + chars))
            yield pd.DataFrame(out, columns=["project", "ord", "state", "start", "end"]).astype({"start": "Int64", "end": "Int64"})

    x = sources.select("project", "ord", "path", "chars", "blank")
    return x.repartition("project").sortWithinPartitions("project", F.collate("path", "UNICODE"), "ord").mapInPandas(scan, "project string, ord int, state string, start int, end int")


def read_files_of(entries: DataFrame, places: DataFrame) -> DataFrame:
    """(project, path, extension, start, end, text) of the source files that are read."""
    return entries.where("source").join(places.where("state = 'read'"), ["project", "ord"]).select("project", "path", "extension", "start", "end", "text")


def projects(files: DataFrame, depth: int = MAX_COMMITS) -> tuple[DataFrame, DataFrame]:
    """(a row for each archive, its read files as rows).

    Archives: project, text, files (path, extension, start, end in order), source_files, assistant_files, commits (null without
    a history that can be read), git_error, metadata (key, value), error. A project's text has PROJECT_TEXT characters at most.
    """
    entries = written(read_entries(files), "entries")
    places = written(placed(entries.where("source")), "places")
    own = written(read_files_of(entries, places), "sources")
    tool = assistant_tool(F.col("path")).isNotNull() & ~F.col("path").rlike(LIBRARIES) & ~F.col("path").rlike(HEAD.pattern)
    per = entries.groupBy("project").agg(F.max("entries").alias("entries"), F.count(F.when(F.col("source"), 1)).alias("source_files"), F.sort_array(F.collect_set(F.when(tool, F.col("path")))).alias("assistant_files"), F.max(F.coalesce(F.col("path").rlike(HEAD.pattern), F.lit(False))).alias("git"), F.max("error").alias("error"))
    large = places.where("state = 'large'").groupBy("project").agg(F.count("*").alias("large"))
    # at most PROJECT_TEXT characters
    read = own.groupBy("project").agg(F.sort_array(F.collect_list(F.struct("start", "end", "path", "extension", "text"))).alias("f"))
    x = per.join(large, "project", "left").join(read, "project", "left").join(commit_lines(history(files, depth)), "project", "left")
    n = F.coalesce(F.size("f"), F.lit(0))
    n = F.when(n < 0, 0).otherwise(n)
    entry = lambda key, value: F.struct(F.lit(key).alias("key"), value.alias("value"))
    rows = F.concat(
        F.array(entry("Fichiers dans l'archive", F.col("entries").cast("string")), entry("Fichiers source analysés", F.concat(n.cast("string"), F.lit(" sur "), F.col("source_files").cast("string")))),
        F.filter(F.array(F.when(F.col("large") > 0, entry("Fichiers source trop gros ignorés", F.col("large").cast("string")))), lambda e: e.isNotNull()), F.array(entry("Historique git", history_row(F.col("commits"), F.col("git_error"), depth))),
        F.transform("assistant_files", lambda p: F.struct(F.lit("Fichier d'assistant IA").alias("key"), p.alias("value"))),
    )
    whole = F.array_join(F.transform("f", lambda e: F.concat(F.lit("===== "), e.path, F.lit(" =====\n"), e.text, F.lit("\n\n"))), "")
    unread = F.coalesce("error", F.when((n == 0) & (F.size("assistant_files") == 0) & ~F.col("git"), F.lit(NOTHING)))
    told = F.transform("f", lambda e: F.struct(e.path.alias("path"), e.extension.alias("extension"), e.start.alias("start"), e.end.alias("end")))
    none = F.array().cast("array<struct<path:string,extension:string,start:int,end:int>>")
    out = x.select("project", F.coalesce(whole, F.lit("")).alias("text"), F.coalesce(told, none).alias("files"), "source_files", "assistant_files", "commits", "git_error", rows.alias("metadata"), unread.alias("error"))
    return out, own
