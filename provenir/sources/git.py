"""Commits of zipped projects: loose and packed objects as rows, delta chains resolved by joins, then the log.

A task reads one archive (of readers.MAX_ARCHIVE at most) and yields its commit objects and the deltas that may lead to
one as rows; trees and blobs are passed over. Deltas are resolved level by level: a round joins those whose base was
resolved in the round before, by its place in the pack or by its id, for all projects at once, so the rounds are the
length of the longest chain. The log walks each project's graph of (id, parents, time), bounded by MAX_GIT, from its
HEAD: the newest commit first, as `git log` without options does. No project passes the driver.
"""

from __future__ import annotations

import heapq
import io
import re
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .readers import MAX_ARCHIVE
from .shared import written

MAX_COMMITS, MAX_GIT = 1000, 300 << 20
COMMIT, TREE, BLOB, TAG, BY_PLACE, BY_ID = 1, 2, 3, 4, 6, 7
OBJECTS = "project string, pack string, kind string, place long, base_place long, base string, id string, data binary"
HEAD = re.compile(r"(^|/)\.git/HEAD$")
FED = 1 << 14


def git_folder(names: list[str]) -> str | None:
    """The .git folder whose HEAD has the shortest path, the first in the archive of equal ones."""
    heads = [n for n in names if HEAD.search(n)]
    return min(heads, key=len)[: -len("HEAD")] if heads else None


def inflated(data: memoryview, at: int, keep: bool) -> tuple[bytes, int]:
    """What the zlib stream at a place holds, and where it ends; without `keep` the content is passed over."""
    d, out = zlib.decompressobj(), []
    while not d.eof:
        fed = data[at : at + FED]
        if not len(fed):
            raise ValueError("pack ends within an object")
        at += len(fed)
        part = d.decompress(fed, 1 << 20)
        while True:
            if keep:
                out.append(part)
            if d.eof or not d.unconsumed_tail:
                break
            part = d.decompress(d.unconsumed_tail, 1 << 20)
    return b"".join(out), at - len(d.unused_data)


def packed(data: bytes) -> Iterator[tuple[int, int | None, str | None, bytes]]:
    """(place, base's place, base's id, content) of a pack's commits, which have no base, and of the deltas that may be commits."""
    if data[:4] != b"PACK" or int.from_bytes(data[4:8], "big") not in (2, 3):
        raise ValueError("not a pack")
    view, at, kinds = memoryview(data), 12, {}
    for _ in range(int.from_bytes(data[8:12], "big")):
        place, c = at, data[at]
        kind, at, base_place, base = c >> 4 & 7, at + 1, None, None
        while c & 0x80:  # the size follows, which the stream tells by itself
            c, at = data[at], at + 1
        if kind == BY_PLACE:
            c, at = data[at], at + 1
            back = c & 0x7F
            while c & 0x80:
                c, at = data[at], at + 1
                back = (back + 1) << 7 | c & 0x7F
            base_place = place - back
        elif kind == BY_ID:
            base, at = data[at : at + 20].hex(), at + 20
        # a base lies before its delta, so what a chain of places leads to is known here
        root = kinds[place] = kinds.get(base_place, BLOB) if kind == BY_PLACE else kind
        content, at = inflated(view, at, root in (COMMIT, BY_ID))
        if root in (COMMIT, BY_ID):
            yield place, base_place, base, content


def patched(base: bytes, delta: bytes) -> bytes:
    """A delta's instructions applied to its base: copies of the base's bytes, and bytes of its own."""

    def number(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            c, at = delta[at], at + 1
            value, shift = value | (c & 0x7F) << shift, shift + 7
            if not c & 0x80:
                return value, at

    size, at = number(0)
    wanted, at = number(at)
    if size != len(base):
        raise ValueError("delta of another base")
    out = []
    while at < len(delta):
        c, at = delta[at], at + 1
        if c & 0x80:
            fields = []
            for bit in range(7):
                if c >> bit & 1:
                    fields.append((bit, delta[at]))
                    at += 1
            start = sum(v << 8 * bit for bit, v in fields if bit < 4)
            length = sum(v << 8 * (bit - 4) for bit, v in fields if bit >= 4) or 0x10000
            out.append(base[start : start + length])
        elif c:
            out.append(delta[at : at + c])
            at += c
        else:
            raise ValueError("reserved instruction in a delta")
    done = b"".join(out)
    if len(done) != wanted:
        raise ValueError("delta of wrong length")
    return done


def head_of(z: zipfile.ZipFile, folder: str, names: set[str]) -> str:
    """The id of the commit that HEAD leads to."""
    refs = {}
    if folder + "packed-refs" in names:
        for line in z.read(folder + "packed-refs").decode("utf-8", "replace").splitlines():
            if re.match(r"[0-9a-f]{40} ", line):
                refs[line[41:].strip()] = line[:40]
    name = "HEAD"
    for _ in range(8):
        said = z.read(folder + name).decode("utf-8", "replace").strip() if folder + name in names else refs.get(name, "")
        if re.fullmatch(r"[0-9a-f]{40}", said):
            return said
        if not said.startswith("ref:"):
            raise ValueError(f"Could not find {name}.")
        name = said[4:].strip()
    raise ValueError("HEAD leads in a circle")


def objects_of(project: str, content: bytes) -> Iterator[tuple]:
    """Rows of OBJECTS: head, shallow, commit, delta and error. An archive without .git has none."""
    row = lambda kind, pack=None, place=None, base_place=None, base=None, id_=None, data=None: (project, pack, kind, place, base_place, base, id_, data)
    if content[:4] != b"PK\x03\x04" or len(content) > MAX_ARCHIVE:
        return
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            entries = [e for e in z.infolist() if not e.is_dir() and not e.filename.startswith("__MACOSX/")]
            folder = git_folder([e.filename for e in entries])
            if folder is None:
                return
            inside = [e for e in entries if e.filename.startswith(folder)]
            if sum(e.file_size for e in inside) > MAX_GIT:
                yield row("error", data="dossier .git trop volumineux".encode())
                return
            names = {e.filename for e in inside}
            yield row("head", id_=head_of(z, folder, names))
            if folder + "shallow" in names:
                for line in z.read(folder + "shallow").decode("ascii", "replace").split():
                    yield row("shallow", id_=line)
            for e in inside:
                name = e.filename[len(folder) :]
                if re.fullmatch(r"objects/[0-9a-f]{2}/[0-9a-f]{38}", name):
                    data = memoryview(z.read(e))
                    if zlib.decompressobj().decompress(data, 7) == b"commit ":
                        yield row("commit", data=inflated(data, 0, True)[0].split(b"\0", 1)[1])
                elif re.fullmatch(r"objects/pack/[^/]+\.pack", name):
                    for place, base_place, base, data in packed(z.read(e)):
                        yield row("commit" if base_place is None and base is None else "delta", e.filename, place, base_place, base, None, data)
    except (ValueError, KeyError, IndexError, zlib.error, zipfile.BadZipFile) as e:
        yield row("error", data=str(e).encode()[:200])


def read_objects(files: DataFrame, rows: int = 1000) -> DataFrame:
    """OBJECTS of binaryFile rows (path, content)."""
    names = [c.split()[0] for c in OBJECTS.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            for p, c in zip(x["path"], x["content"], strict=True):
                held = []
                for found in objects_of(p, bytes(c)):
                    held.append(found)
                    if len(held) == rows:
                        yield _frame(held, names)
                        held = []
                yield _frame(held, names)

    return files.select("path", "content").mapInPandas(run, OBJECTS)


def _frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=names).astype({"place": "Int64", "base_place": "Int64"})


def _named(data: Column) -> Column:
    """The id of a commit: the SHA-1 of its kind, length and content."""
    return F.sha1(F.concat(F.lit("commit ").cast("binary"), F.octet_length(data).cast("string").cast("binary"), F.unhex(F.lit("00")), data))


def resolved(objects: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((project, id, data) of every commit, (project, error) of deltas that don't fit): one round for each level of the chains."""

    @F.pandas_udf("struct<data:binary,error:string>")
    def patch(base: pd.Series, delta: pd.Series) -> pd.DataFrame:
        out = []
        for b, d in zip(base, delta, strict=True):
            try:
                out.append((patched(b, d), None))
            except (ValueError, IndexError) as e:
                out.append((None, str(e) or "broken delta"))
        return pd.DataFrame(out, columns=["data", "error"])

    whole = objects.where("kind = 'commit'").select("project", "pack", "place", _named(F.col("data")).alias("id"), "data")
    deltas = objects.where("kind = 'delta'")
    done = last = written(whole, "commits")
    wrong = objects.where("kind = 'error'").select("project", F.col("data").cast("string").alias("error"))
    if deltas.isEmpty():
        return done.select("project", "id", "data"), wrong
    by_place = deltas.where("base is null").select("project", "pack", "place", F.col("base_place").alias("at"), F.col("data").alias("delta"))
    by_id = deltas.where("base is not null").select("project", "pack", "place", F.col("base").alias("at"), F.col("data").alias("delta"))
    while True:
        one = last.select("project", "pack", F.col("place").alias("at"), F.col("data").alias("base")).join(by_place, ["project", "pack", "at"])
        two = last.select("project", F.col("id").alias("at"), F.col("data").alias("base")).dropDuplicates(["project", "at"]).join(by_id, ["project", "at"])
        both = one.select("project", "pack", "place", "base", "delta").unionByName(two.select("project", "pack", "place", "base", "delta"))
        made = written(both.select("project", "pack", "place", patch("base", "delta").alias("p")), "level")
        if made.isEmpty():
            return done.select("project", "id", "data"), wrong
        wrong = wrong.unionByName(made.where("p.error is not null").select("project", "p.error"))
        last = made.where("p.error is null").select("project", "pack", "place", _named(F.col("p.data")).alias("id"), F.col("p.data").alias("data"))
        done = done.unionByName(last)


def parsed(commits: DataFrame) -> DataFrame:
    """project, id, parents, time (of the committer), author, email, message of commit objects."""
    text = F.make_valid_utf8(F.col("data").cast("string"))
    x = commits.dropDuplicates(["project", "id"]).select("project", "id", text.alias("t")).withColumn("head", F.substring_index("t", "\n\n", 1))
    by = r"(?m)^author (.*?) ?<([^>\n]*)>"
    return x.select(
        "project", "id", F.regexp_extract_all("head", F.lit(r"(?m)^parent ([0-9a-f]{40})$"), 1).alias("parents"), F.coalesce(F.try_to_number(F.nullif(F.regexp_extract("head", r"(?m)^committer .*> (\d{1,15}) ", 1), F.lit("")), F.lit("9" * 15)).cast("long"), F.lit(0)).alias("time"),
        F.regexp_extract("head", by, 1).alias("author"), F.regexp_extract("head", by, 2).alias("email"), F.expr("substr(t, length(head) + 3)").alias("message"),
    )


def walked(graph: dict[str, tuple[list[str], int]], head: str, shallow: set[str], depth: int) -> list[str]:
    """Ids from head on: of the commits met so far always the newest, of equal ones that met last; each once."""
    seen, out, met = {head}, [], [(0, 0, head)]
    while met and len(out) < depth:
        _, _, at = heapq.heappop(met)
        if at not in graph:
            raise ValueError(f"Could not find {at}.")
        out.append(at)
        for p in [] if at in shallow else graph[at][0]:
            if p not in seen:
                seen.add(p)
                heapq.heappush(met, (-graph[p][1] if p in graph else 0, -len(seen), p))
    return out


def history(files: DataFrame, depth: int = MAX_COMMITS) -> DataFrame:
    """(project, ord, author, email, message, error) of the last `depth` commits of every zipped project, from HEAD on.

    A project whose history can't be read has one row with an error; one without .git, or another file, has none.
    """
    objects = written(read_objects(files), "objects")
    found, wrong = resolved(objects)
    commits = written(parsed(found), "parsed")
    graph = commits.select("project", F.lit("commit").alias("kind"), "id", "parents", "time")
    ends = objects.where("kind in ('head', 'shallow')").select("project", "kind", "id", F.array().cast("array<string>").alias("parents"), F.lit(0).cast("long").alias("time"))
    broken = wrong.groupBy("project").agg(F.min("error").alias("e")).select("project", F.lit("error").alias("kind"), F.col("e").alias("id"), F.array().cast("array<string>").alias("parents"), F.lit(0).cast("long").alias("time"))

    def log(x: pd.DataFrame) -> pd.DataFrame:
        of = {k: g for k, g in x.groupby("kind")}
        try:
            if "error" in of:
                raise ValueError(of["error"]["id"].iloc[0])
            c = of.get("commit", x.iloc[:0])
            ids = walked({i: (list(p), t) for i, p, t in zip(c["id"], c["parents"], c["time"], strict=True)}, of["head"]["id"].iloc[0], set(of["shallow"]["id"]) if "shallow" in of else set(), depth)
            return pd.DataFrame({"project": x["project"].iloc[0], "ord": range(len(ids)), "id": ids, "error": None})
        except (ValueError, KeyError) as e:
            return pd.DataFrame({"project": [x["project"].iloc[0]], "ord": pd.array([None], dtype="Int64"), "id": [None], "error": [str(e.args[0])]})

    order = graph.unionByName(ends).unionByName(broken).groupBy("project").applyInPandas(log, "project string, ord long, id string, error string")
    return order.join(commits.drop("parents", "time"), ["project", "id"], "left").select("project", "ord", "author", "email", "message", "error")


def commit_lines(log: DataFrame) -> DataFrame:
    """(project, commits, git_error): what `files.project` looks at, a text for each of the commits (MAX_COMMITS at most)."""
    line = F.when(F.col("ord").isNotNull(), F.struct("ord", F.concat("author", F.lit(" <"), "email", F.lit(">\n"), "message").alias("c")))
    x = log.groupBy("project").agg(F.sort_array(F.collect_list(line)).alias("c"), F.max("error").alias("git_error"))
    return x.select("project", F.when(F.col("git_error").isNull(), F.transform("c", lambda e: e.c)).alias("commits"), "git_error")


def history_row(commits: Column, error: Column, depth: int = MAX_COMMITS) -> Column:
    """What a report's table says of the history."""
    n = F.size(commits)
    read = F.concat(n.cast("string"), F.when(n >= depth, " derniers").otherwise(""), F.lit(" commit(s) lu(s)"))
    return F.when(commits.isNotNull(), read).when(error.isNotNull(), F.concat(F.lit("illisible ("), error, F.lit(")"))).otherwise("absent (dossier .git non inclus)")
