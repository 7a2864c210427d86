"""Fill-in-middle examples: texts cut into prefix, middle and suffix at code points and put together in another order.

An index of exceptions tells code points from bytes: for a batch of texts, which lies in one buffer, only the multibyte
characters are recorded, with their places and the bytes in excess so far. A cut at a code point becomes a byte by
one searchsorted among them and an addition, as does a byte a code point; spans of ASCII take no entry.

Defined results: a null text is empty; a null doc_id hashes as an empty string; empty texts and those that hold a
sentinel stay as they are (form plain), as do others by their hash; repeated rows give repeated rows; an empty table
an empty one; very long texts are cut like others, a batch is bounded in bytes by Spark; extra columns are kept,
whatever they are called: the new column gets underscores before its name where that is taken.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from .common import unused

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Of 100 hashes, those from here on stay plain; of the others' 100, those under SPM give the suffix first.
PLAIN, SPM = 90, 20
KIND = "struct<n:long,form:string,prefix_chars:long,middle_chars:long,output:string>"
REBUILT = "struct<text:string,prefix_chars:long,middle_chars:long>"


class Exceptions:
    """The multibyte characters of a buffer of UTF-8."""

    def __init__(self, data: np.ndarray):
        self.byte = np.flatnonzero(data >= 0xC0)
        lead = data[self.byte]
        extra = 1 + (lead >= 0xE0).astype(np.int64) + (lead >= 0xF0)
        self.excess = np.concatenate(([0], np.cumsum(extra)))
        self.point = self.byte - self.excess[:-1]

    def to_byte(self, point: np.ndarray) -> np.ndarray:
        return point + self.excess[np.searchsorted(self.point, point)]

    def to_point(self, byte: np.ndarray) -> np.ndarray:
        return byte - self.excess[np.searchsorted(self.byte, byte)]


def _buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in one array, and the bounds of the texts in it; nulls are empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, bounds, data = texts.buffers()
    bounds = np.frombuffer(bounds, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if not len(texts) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, dtype=np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]


def _strings(parts: list[bytes]) -> pa.Array:
    bounds = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(parts), pa.py_buffer(bounds), pa.py_buffer(b"".join(parts))).cast(pa.string())


def _cut(texts: pa.Array, h: np.ndarray) -> pa.Array:
    """One struct of KIND for each text; h: four hashes for each."""
    data, bounds = _buffer(texts)
    index, raw = Exceptions(data), data.tobytes()
    points = index.to_point(bounds)
    n = np.diff(points)
    a, b = h[:, 0] % (n + 1), h[:, 1] % (n + 1)
    first, second = np.minimum(a, b), np.maximum(a, b)
    at, to = index.to_byte(points[:-1] + first), index.to_byte(points[:-1] + second)
    plain = (n == 0) | (h[:, 2] % 100 >= PLAIN)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        plain |= pc.fill_null(pc.match_substring(texts, mark.decode()), False).to_numpy(zero_copy_only=False)
    suffix_first = h[:, 3] % 100 < SPM
    out = []
    for p, s, x, i, j, y in zip(plain.tolist(), suffix_first.tolist(), bounds[:-1].tolist(), at.tolist(), to.tolist(), bounds[1:].tolist(), strict=True):
        if p:
            out.append(raw[x:y])
        elif s:
            out.append(b"".join((SUFFIX, raw[j:y], PREFIX, raw[x:i], MIDDLE, raw[i:j])))
        else:
            out.append(b"".join((PREFIX, raw[x:i], SUFFIX, raw[j:y], MIDDLE, raw[i:j])))
    form = np.where(plain, "plain", np.where(suffix_first, "spm", "psm"))
    sized = [pa.array(v, type=pa.int64(), mask=plain) for v in (first, second - first)]
    return pa.StructArray.from_arrays([pa.array(n, type=pa.int64()), pa.array(form.tolist(), pa.string()), *sized, _strings(out)], names=["n", "form", "prefix_chars", "middle_chars", "output"])


def _rebuilt(outputs: pa.Array, forms: list[str]) -> pa.Array:
    """One struct of REBUILT for each output. Sentinels are found as bytes: no text put between them holds one."""
    data, bounds = _buffer(outputs)
    index, raw = Exceptions(data), data.tobytes()
    texts, prefix, middle = [], np.zeros((len(forms), 2), np.int64), np.zeros((len(forms), 2), np.int64)
    for k, (form, x, y) in enumerate(zip(forms, bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
        if form not in ("psm", "spm"):
            texts.append(raw[x:y])
            continue
        inner = raw.index(SUFFIX if form == "psm" else PREFIX, x + 3, y)
        m = raw.index(MIDDLE, inner + 3, y)
        one, two = (x + 3, inner), (inner + 3, m)
        (i, j), (s, t) = (one, two) if form == "psm" else (two, one)
        prefix[k], middle[k] = (i, j), (m + 3, y)
        texts.append(b"".join((raw[i:j], raw[m + 3 : y], raw[s:t])))
    plain = np.array([f not in ("psm", "spm") for f in forms], dtype=bool)
    sizes = [pa.array(index.to_point(v[:, 1]) - index.to_point(v[:, 0]), type=pa.int64(), mask=plain) for v in (prefix, middle)]
    return pa.StructArray.from_arrays([_strings(texts), *sizes], names=["text", "prefix_chars", "middle_chars"])


def hashes(doc_id: Column, seed: int = 1) -> list[Column]:
    """The first four 8-digit groups of the hex SHA-256 of seed, a colon and the id, as integers."""
    hexed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(hexed, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def transform(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", into: str = "fim", seed: int = 1) -> DataFrame:
    """docs with the struct column `into`: n (code points), form (psm, spm or plain), prefix_chars, middle_chars, output."""
    (into,) = unused(docs, into)
    names = unused(docs, *[f"h{i}" for i in range(4)])
    schema = StructType([*docs.schema.fields]).add(into, _parse_datatype_string(KIND))
    at, keep = docs.columns.index(text), len(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = np.stack([b.column(keep + i).to_numpy(zero_copy_only=False) for i in range(4)], axis=1).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([*b.columns[:keep], _cut(b.column(at), h)], names=schema.names)

    return docs.select("*", *[c.alias(k) for c, k in zip(hashes(F.col(f"`{doc_id}`"), seed), names, strict=True)]).mapInArrow(run, schema)


def restore(df: DataFrame, column: str = "fim", into: str = "restored") -> DataFrame:
    """df with the struct column `into`: text, prefix_chars, middle_chars, from form and output of `column` alone."""
    (into,) = unused(df, into)
    form, output = unused(df, "form", "output")
    schema = StructType([*df.schema.fields]).add(into, _parse_datatype_string(REBUILT))
    keep = len(df.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:keep], _rebuilt(b.column(keep + 1), b.column(keep).to_pylist())], names=schema.names)

    return df.select("*", F.col(f"`{column}`.form").alias(form), F.col(f"`{column}`.output").alias(output)).mapInArrow(run, schema)
