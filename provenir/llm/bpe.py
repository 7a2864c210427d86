"""Byte-pair encoding and decoding: speculate, verify, and merge exactly only where that fails.

A word's tokens are proposed by greedy longest match. They are the tokens that merging in rank order would give if
and only if every two neighbours are compatible (merging the two strings gives the two tokens back), so all
neighbours of a batch's new words are tested at once in numpy; words with an incompatible pair are merged exactly.
Each Python worker keeps what it has learned of words in a table of about MAX_BYTES at most.

The vocabulary is a JSON file of the tokenizers library of the kind lower-case words with an end-of-word suffix
(NFC, lower case letter by letter, words and signs by a fixed pattern, bytes as letters, no decoder: decoding joins
the tokens by spaces). It is read on the driver and broadcast; its size does not depend on the data.

Defined results: a null text is empty and has no tokens; strings of special tokens in a text are those tokens;
repeated rows give repeated rows; extra columns are kept by `encode` and `decode`.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_BYTES = 64 << 20
#: What a word takes beside its letters and ids.
PER_WORD = 160
NONE = np.iinfo(np.int64).max


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable Latin-1 bytes for themselves, the others from U+0100 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256))
    return [chr(b) if b in own else chr(256 + next(rest)) for b in range(256)]


class Vocabulary:
    """Tables of one vocabulary. Tokens are numbered inside by merge rank, single letters first."""

    def __init__(self, source: str) -> None:
        spec = json.loads(source)
        model = spec["model"]
        self.end = model.get("end_of_word_suffix") or ""
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        made = [a + b for a, b in merges]
        if len({*made}) != len(made):
            raise ValueError("a vocabulary in which two merges make the same token")
        vocab, products = model["vocab"], {*made}
        letters = [t for t in sorted(vocab, key=vocab.get) if t not in products]
        names = letters + made
        self.number = {t: i for i, t in enumerate(names)}
        self.ids = np.array([vocab[t] for t in names], dtype=np.uint32)
        n = len(names)
        self.left, self.right = np.arange(n), np.arange(n)
        for i, (a, b) in enumerate(merges, len(letters)):
            self.left[i], self.right[i] = self.number[a], self.number[b]
        self.n_letters, self.n = len(letters), n
        key = self.left[len(letters) :] * n + self.right[len(letters) :]
        order = np.argsort(key)
        self.keys, self.products = key[order], order + len(letters)
        self.pair = dict(zip(self.keys.tolist(), self.products.tolist(), strict=True))
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_split = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        space = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
        self.pattern = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{space}\p{{L}}\p{{N}}]+")
        top = max(int(self.ids.max()), *self.special.values(), 0) + 1
        self.token = [""] * top
        for t, i in zip(names, self.ids.tolist(), strict=True):
            self.token[i] = t
        for t, i in self.special.items():
            self.token[i] = t
        self.letters = dict(enumerate(byte_letters()))
        reach = np.ones(n, dtype=bool)
        ranks = np.arange(len(letters), n)
        alone = self.compatible(self.left[ranks], self.right[ranks], ranks)
        reach[ranks] = alone
        for i in ranks:  # a part that is never made makes nothing
            reach[i] &= reach[self.left[i]] and reach[self.right[i]]
        self.greedy = {t: i for t, i in self.number.items() if reach[i]}
        self.longest: dict[str, int] = {}  # by the first two letters, or the only one
        for t in self.greedy:
            letters_only = t.removesuffix(self.end) if self.end else t
            self.longest[letters_only[:2]] = max(self.longest.get(letters_only[:2], 1), len(letters_only))
        self.words: dict[str, bytes] = {}
        self.held = 0

    def merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The number of the token that a and b merge to, NONE where they don't."""
        k = a * self.n + b
        at = np.minimum(np.searchsorted(self.keys, k), len(self.keys) - 1)
        return np.where(self.keys[at] == k, self.products[at], NONE)

    def compatible(self, first: np.ndarray, second: np.ndarray, limit: np.ndarray | None = None) -> np.ndarray:
        """Whether merging the letters of each pair by rank keeps the border between the two tokens.

        Every merge across the border that comes before the one in `limit`, or before the later merge of the parts
        that touch it, breaks it; the later made part is taken apart again and again.
        """
        good = np.zeros(len(first), dtype=bool)
        at, a, b = np.arange(len(first)), first.astype(np.int64), second.astype(np.int64)
        limit = np.full(len(first), NONE) if limit is None else limit.astype(np.int64)
        while len(at):
            live = self.merged(a, b) >= limit
            at, a, b, limit = at[live], a[live], b[live], limit[live]
            split_a = (self.right[a] != a) & ((a > b) | (self.left[b] == b))
            split_b = ~split_a & (self.left[b] != b)
            good[at[~(split_a | split_b)]] = True
            limit = np.where(split_a, a, np.where(split_b, b + 1, limit))
            a, b = np.where(split_a, self.right[a], a), np.where(split_b, self.left[b], b)
            live = split_a | split_b
            at, a, b, limit = at[live], a[live], b[live], limit[live]
        return good

    def proposed(self, parts: str) -> list[int]:
        """Greedy longest match over a word's letters."""
        found, i, n, get, longest = [], 0, len(parts), self.greedy.get, self.longest.get
        while i < n:
            for j in range(min(n, i + longest(parts[i : i + 2], 1)), i, -1):
                t = get(parts[i:j] + self.end if j == n else parts[i:j])
                if t is not None:
                    found.append(t)
                    i = j
                    break
            else:
                raise ValueError(f"no token for {parts[i]!r}")
        return found

    def exact(self, parts: str) -> list[int]:
        """Merging by rank, the leftmost of equal ones first: a heap of pairs over linked places."""
        at = [self.number[c] for c in parts[:-1]] + [self.number[parts[-1] + self.end]]
        get, n, size = self.pair.get, self.n, len(at)
        after, before = [*range(1, size), -1], [*range(-1, size - 1)]
        heap = [(t, i) for i in range(size - 1) if (t := get(at[i] * n + at[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            token, i = heapq.heappop(heap)
            j = after[i]
            if at[i] < 0 or j < 0 or get(at[i] * n + at[j]) != token:
                continue  # one of the two has been merged since
            at[i], at[j] = token, -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (t := get(token * n + at[k])) is not None:
                    heapq.heappush(heap, (t, i))
            if (h := before[i]) >= 0 and (t := get(at[h] * n + token)) is not None:
                heapq.heappush(heap, (t, h))
        return [t for t in at if t >= 0]

    def learn(self, words: list[str]) -> None:
        """Put the ids of new words into the table."""
        parts = [w.encode("utf-8").decode("latin-1").translate(self.letters) for w in words]
        guesses = [self.proposed(p) for p in parts]
        sizes = np.fromiter(map(len, guesses), dtype=np.int64, count=len(guesses))
        flat = np.concatenate([np.asarray(g, dtype=np.int64) for g in guesses])
        owner = np.repeat(np.arange(len(words)), sizes)
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        pairs, back = np.unique(flat[inner] * self.n + flat[inner + 1], return_inverse=True)
        wrong = ~self.compatible(pairs // self.n, pairs % self.n)[back]
        ids, ends = self.ids[flat].tobytes(), np.cumsum(sizes) * 4
        for w, a, b in zip(words, (ends - sizes * 4).tolist(), ends.tolist(), strict=True):
            self.words[w] = ids[a:b]
        for i in np.unique(owner[inner[wrong]]).tolist():
            self.words[words[i]] = self.ids[self.exact(parts[i])].tobytes()

    def split(self, text: str) -> list[str]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return self.pattern.findall(text.lower())

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        pieces = [[self.split(p) if k % 2 == 0 else p for k, p in enumerate(self.special_split.split(t) if self.special_split else [t])] for t in texts]
        seen: set[str] = set()
        for own in pieces:
            seen.update(*own[::2])
        new = seen - self.words.keys()
        if self.held > MAX_BYTES:
            self.words.clear()
            self.held, new = 0, seen
        if new:
            self.learn(list(new))
            self.held += sum(PER_WORD + 2 * len(w) + len(self.words[w]) for w in new)
        get = self.words.__getitem__
        return [b"".join([b"".join(map(get, p)) if k % 2 == 0 else self.special[p].to_bytes(4, "little") for k, p in enumerate(own)]) for own in pieces]

    def decode(self, ids: bytes) -> str:
        return " ".join(map(self.token.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


_loaded: dict[str, Vocabulary] = {}


def _vocabulary(source: str) -> Vocabulary:
    """One object per Python worker and vocabulary."""
    key = hashlib.sha256(source.encode()).hexdigest()
    if key not in _loaded:
        _loaded[key] = Vocabulary(source)
    return _loaded[key]


def _source(spark: SparkSession, path: str):
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, path: str, text: str = "text", into: str = "ids") -> DataFrame:
    """docs with the column `into`: array<int> of ids."""
    source = _source(docs.sparkSession, path)

    @F.pandas_udf("array<int>")
    def ids(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        v = _vocabulary(source.value)
        for s in texts:
            yield pd.Series([np.frombuffer(i, dtype="<u4").astype(np.int32) for i in v.encode([t or "" for t in s])])

    return docs.withColumn(into, ids(F.col(text)))


def decode(df: DataFrame, path: str, ids: str = "ids", into: str = "text") -> DataFrame:
    """df with the column `into`: the text of the ids, special tokens included; null ids are an empty text."""
    source = _source(df.sparkSession, path)

    @F.pandas_udf("string")
    def text(column: Iterator[pd.Series]) -> Iterator[pd.Series]:
        v = _vocabulary(source.value)
        for s in column:
            yield pd.Series([v.decode(np.asarray([] if x is None else x, dtype="<u4").tobytes()) for x in s])

    return df.withColumn(into, text(F.col(ids)))


def round_trip(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: every text encoded and decoded again, in one pass.

    The digests are of the ids as little-endian unsigned 32-bit integers and of the decoded text in UTF-8.
    """
    source = _source(docs.sparkSession, path)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v = _vocabulary(source.value)
        sha = hashlib.sha256
        for x in frames:
            ids = v.encode([t or "" for t in x["text"]])
            yield pd.DataFrame({"doc_id": x["doc_id"], "n_tokens": [len(i) // 4 for i in ids], "ids_sha256": [sha(i).hexdigest() for i in ids], "decoded_sha256": [sha(v.decode(i).encode()).hexdigest() for i in ids]})

    kind = docs.schema[doc_id].dataType.simpleString()
    return light(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))).mapInPandas(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def light(df: DataFrame, rows: int = 1000) -> DataFrame:
    """Batches of fewer rows, so that a Python worker holds few texts at a time."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    return df
